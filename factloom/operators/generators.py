"""Questions about paths and failures: several generators over flows and traces, one typed table, capped samples by stratum."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import traces as tr
from factloom.operators.sampling import bottom_k

#: Columns of a question.
COLUMNS = "generator string, level string, category string, answer_type string, stratum string, scope string, question string, ground_truth string, explanation string"
ARROW = "→"


@dataclass(frozen=True)
class Generator:
    """rows(flows, traces) gives (stratum, scope, subject array<string>, truth); cap: questions of a stratum at most, None for all; total: of all strata."""

    name: str
    level: str
    category: str
    answer_type: str
    pattern: str
    rows: Callable[[DataFrame, DataFrame], DataFrame]
    cap: int | None = None
    total: int | None = None


def _filled(pattern: str, subject: Column) -> Column:
    out = F.lit(pattern)
    for i in range(4):
        out = F.replace(out, F.lit(f"{{{i}}}"), F.coalesce(F.get(subject, F.lit(i)), F.lit("")))
    return out


def _rows(df: DataFrame, stratum: str, subject: list[str], truth: Column) -> DataFrame:
    parts = F.array(*[F.col(c).cast("string") for c in subject])
    return df.select(F.col(stratum).cast("string").alias("stratum"), F.concat_ws("/", parts).alias("scope"), parts.alias("subject"), truth.alias("truth"))


def _path(c: str = "path") -> Column:
    return F.array_join(c, f" {ARROW} ")


def _by_flow(flows: DataFrame, found: DataFrame) -> DataFrame:
    return flows.select("flow_id", "src", "dst", "src_ip", "dst_ip").join(found, "flow_id")


def traceroute(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(_by_flow(flows, tr.first_paths(traces)), "src", ["flow_id", "src", "dst", "dst_ip"], _path())


def reach(flows: DataFrame, traces: DataFrame) -> DataFrame:
    told = F.concat(F.lit("path: "), F.when(F.size("nodes") > 0, _path("nodes")).otherwise("none"), F.lit(", reachable: "), F.col("reachable").cast("string"))
    return _rows(_by_flow(flows, tr.reachability(traces)), "src", ["flow_id", "src", "dst", "dst_ip"], told)


def loop(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(_by_flow(flows, tr.loops(traces)), "dst", ["flow_id", "src", "dst", "trace_no"], F.col("nodes"))


def path_length(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(_by_flow(flows, tr.first_paths(traces)), "src", ["flow_id", "src", "dst"], F.col("n_hops").cast("string"))


def blackhole(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(_by_flow(flows, tr.blackholes(flows, traces)), "dst", ["flow_id", "src", "dst"], F.when(F.col("n_traces") == 0, "no trace").otherwise(F.col("dispositions")))


def blocked(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(_by_flow(flows, tr.blocking_nodes(traces)), "node", ["flow_id", "src", "dst"], F.col("node"))


def asymmetry(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(tr.asymmetric(flows, traces), "a", ["a", "b"], F.col("is_symmetric").cast("string"))


def failure(flows: DataFrame, traces: DataFrame) -> DataFrame:
    """Every link that a trace uses, against the flows that start and end elsewhere and use it: rerouted or cut off."""
    per = F.struct("hop_no", "node")
    hops = traces.where("node IS NOT NULL").groupBy("flow_id", "trace_no").agg(F.array_sort(F.collect_list(per)).alias("h"))
    steps = hops.select("flow_id", "trace_no", F.explode(F.arrays_zip(F.slice("h", 1, F.size("h") - 1).alias("x"), F.slice("h", 2, F.size("h") - 1).alias("y"))).alias("s"))
    used = steps.select("flow_id", "trace_no", F.least("s.x.node", "s.y.node").alias("a"), F.greatest("s.x.node", "s.y.node").alias("b")).where("a <> b").distinct()
    n = traces.groupBy("flow_id").agg(F.count_distinct("trace_no").alias("n"))
    met = used.groupBy("flow_id", "a", "b").agg(F.count("*").alias("using")).join(n, "flow_id")
    own = _by_flow(flows, met).where("src NOT IN (a, b) AND dst NOT IN (a, b)").withColumn("link", F.concat_ws("-", "a", "b"))
    return _rows(own, "link", ["a", "b", "flow_id"], F.when(F.col("using") < F.col("n"), "reroute").otherwise("outage"))


def blocking_rule(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(_by_flow(flows, tr.blocking_rules(traces)), "dst", ["flow_id", "src", "dst"], F.col("rules"))


def tolerance(flows: DataFrame, traces: DataFrame) -> DataFrame:
    return _rows(_by_flow(flows, tr.multiplicity(traces)), "src", ["flow_id", "src", "dst"], F.concat(F.col("tolerant").cast("string"), F.lit(" ("), F.col("n_paths"), F.lit(")")))


#: The caps are fixed values of the two levels.
L4 = (
    Generator("traceroute_path", "L4", "Reachability_Analysis", "text", "Flow {0}: which way does traffic from {1} to {2} ({3}) take?", traceroute),
    Generator("reachability_status", "L4", "Reachability_Analysis", "text", "Flow {0}: is {2} ({3}) reached from {1}, and which way?", reach, total=30),
    Generator("loop_detection", "L4", "Reachability_Analysis", "text", "Flow {0}: which nodes does trace {3} from {1} to {2} meet again?", loop),
    Generator("bounded_path_length", "L4", "Reachability_Analysis", "number", "Flow {0}: how many hops are between {1} and {2}?", path_length),
    Generator("blackhole_detection", "L4", "Reachability_Analysis", "text", "Flow {0}: how is traffic from {1} to {2} lost?", blackhole),
    Generator("isolation_check", "L4", "Security_Policy", "text", "Flow {0}: where is traffic from {1} to {2} denied?", blocked, cap=2, total=8),
    Generator("path_asymmetry", "L4", "Reachability_Analysis", "boolean", "Do {0} and {1} reach each other over the same path?", asymmetry, total=5),
)
L5 = (
    Generator("link_failure_impact", "L5", "What_If_Analysis", "text", "If the link between {0} and {1} fails, what happens to flow {2}?", failure, cap=5, total=30),
    Generator("acl_blocking", "L5", "Security_Policy", "text", "Flow {0}: which rules block traffic from {1} to {2}?", blocking_rule, cap=5),
    Generator("k_failure_tolerance", "L5", "What_If_Analysis", "text", "Flow {0}: does traffic from {1} to {2} survive one failure, and how many paths are there?", tolerance, cap=5),
)


def questions(flows: DataFrame, traces: DataFrame, generators: tuple[Generator, ...] = L4 + L5, seed: int = 42) -> DataFrame:
    """All generators' questions with the columns COLUMNS and id: those of a stratum with the smallest hashes, then those of all strata.

    Answers that are null or empty give no question. The same seed gives the same questions for any partitioning; a
    generator whose strata differ in size takes its total evenly by hash, not from the first strata.
    """
    parts = []
    for g in generators:
        found = g.rows(flows, traces).where("truth <> ''")
        if g.cap is not None:
            found = bottom_k(found, ["stratum"], ["scope"], g.cap, seed)
        if g.total is not None:
            found = bottom_k(found, [], ["scope"], g.total, seed)
        parts.append(found.select(
            F.lit(g.name).alias("generator"), F.lit(g.level).alias("level"), F.lit(g.category).alias("category"), F.lit(g.answer_type).alias("answer_type"), "stratum", "scope", _filled(g.pattern, F.col("subject")).alias("question"),
            F.col("truth").alias("ground_truth"), F.concat(F.lit(f"metric `{g.name}` on "), F.col("scope")).alias("explanation"),
        ))
    return reduce(DataFrame.unionByName, parts).withColumn("id", F.concat_ws("_", F.upper("generator"), F.replace(F.col("scope"), F.lit("/"), F.lit("_"))))
