"""Trees without a schema: every node of JSON documents as a row, keys without their namespace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.sources.staging import staged


def nodes(documents: DataFrame, keys: list[str], json: str, clean: bool = True) -> DataFrame:
    """(keys, path, depth, kind, value): each node of the documents' JSON, the root as $; kind is object, array, null or scalar, value a scalar's text.

    A round takes all nodes of one depth apart, over all documents at once; rounds end with the deepest. With clean, a
    key counts from behind its last colon, at every depth; where keys of one object become alike, the last in order of
    the whole keys stays, with what is below it. Texts that aren't JSON and nulls have no nodes. Rows with equal keys
    and equal text give equal rows.
    """
    spark = documents.sparkSession
    root = documents.select(*keys, F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    # ids tell apart documents with equal keys
    level = staged(root.select(F.monotonically_increasing_id().alias("doc"), *keys, F.lit("$").alias("path"), F.lit(0).alias("depth"), "v"), "nodes")
    found = []
    while not level.isEmpty():
        shape = F.schema_of_variant("v")
        kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null").otherwise("scalar")
        level = level.withColumn("kind", kind)
        found.append(level.select(*keys, "path", "depth", "kind", F.when(F.col("kind") == "scalar", F.try_variant_get("v", "$", "string")).alias("value")))
        columns = ", ".join(["doc", *[f"`{k}`" for k in keys]])
        step = spark.sql(f"SELECT {columns}, path, depth, kind, e.pos, e.key, e.value AS v FROM {{level}} AS l, LATERAL variant_explode(l.v) AS e WHERE kind IN ('object', 'array')", level=level)
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.substring_index("key", ":", -1) if clean else F.col("key")))
        step = step.withColumn("path", F.concat("path", name)).withColumn("depth", F.col("depth") + 1)
        if clean:
            last = Window.partitionBy("doc", "path").orderBy(F.desc("key"))
            step = step.withColumn("k", F.row_number().over(last)).where("k = 1")
        level = staged(step.select("doc", *keys, "path", "depth", "v"), "nodes")
    if not found:
        return documents.select(*keys, F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit("").alias("kind"), F.lit("").alias("value")).limit(0)
    return reduce(DataFrame.union, found)


def shapes(found: DataFrame) -> DataFrame:
    """(path, kind, n, n_values): which paths documents have, array places as [*], and how often."""
    return found.withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[*]")).groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))
