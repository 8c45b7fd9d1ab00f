"""Connected components of an edge table, by repeated contraction towards the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstaged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (a long, b long): component names the node's connected part.

    Each round joins every node to its smallest neighbour, renames both ends and drops what has become a loop;
    the number of nodes at least halves, so rounds grow with the logarithm of the largest part. Repeated edges,
    loops and nulls do no harm; no edges give no rows. Every table has at most one row for each edge or node, and
    each round is written to the shared folder, and deleted when it is used up.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        step = staged(ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")), "step")
        steps.append(step)
        renamed = (
            edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .where("a <> b")
            .distinct()
        )
        before, edges = edges, staged(renamed, "edges")
        unstaged(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[-1].select("node", F.col("to").alias("component"))
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("to"), "component")
        found = step.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    found = staged(found, "found")
    unstaged(edges, *steps)
    return found
