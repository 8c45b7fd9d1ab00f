"""Relational operators that the metrics are instances of, for any keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.sources.staging import staged


def child_count(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Parents with their number of children, 0 if none; children are counted before they are joined."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def argmax_first(df: DataFrame, value: str, order: str) -> DataFrame:
    """The row of the largest value, the first in order of those: one aggregate, no sort of the whole.

    A null value never wins over another; an empty table gives no row.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.min_by(whole, F.struct(F.col(value).isNull(), -F.col(value), F.col(order))).alias("r")).where("r IS NOT NULL").select("r.*")


def argmax_ties(df: DataFrame, value: str) -> DataFrame:
    """All rows of the largest value."""
    return df.join(df.agg(F.max(value).alias("_top")), F.col(value) == F.col("_top")).drop("_top")


def union_members(*members: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, members).distinct()


def full_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that differ between two snapshots: (key, before, after, change)."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.withColumn("change", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed"))


def override(base: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """What-if: base with the values of overrides where there are any; base stays as it is."""
    o = overrides.select(key, F.col(value).alias("_new"))
    return base.join(o, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def value_conflicts(df: DataFrame, value: str, owner: str) -> DataFrame:
    """Values with more than one owner: (value, n, owners)."""
    return df.groupBy(value).agg(F.count_distinct(owner).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set(owner)), lambda x: x.cast("string")), ", ").alias("owners")).where("n > 1")


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with place (from 1, in order within a key) and total (rows of the key); nulls come first.

    No key has to fit in a task: rows are split by ranges of key and order and written, places are counted within the
    piece of a key in one range, and the counts of the pieces, one row each, are summed up to each piece's offset.
    """
    ranged = staged(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    pieces = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n")
    offsets = pieces.select(F.col(key).alias("_key"), F.col("_range").alias("_piece"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("total"))
    own = ranged.withColumn("place", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    out = own.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_piece")))
    return out.withColumn("place", F.col("place") + F.col("_before")).drop("_key", "_piece", "_before", "_range")


def split_by_position(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """8:1:1 by place within a key: train, validation, test."""
    first, second = F.floor(F.col("total") * F.lit(0.8)), F.floor(F.col("total") * F.lit(0.1))
    split = F.when(F.col("place") <= first, "train").when(F.col("place") <= first + second, "validation").otherwise("test")
    return numbered(df, key, order).withColumn("split", split).drop("place", "total")


def within_budget(df: DataFrame, keys: list[str], order: list[Column | str], size: str, budget: int) -> DataFrame:
    """Rows before the first that would exceed the budget, within each key."""
    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", upto).where(F.col("running") <= budget)


def seeded_order(ids: list[str], seed: int = 42) -> Column:
    """What a seeded shuffle orders by: the MD5 of seed and ids, as text; the same in any engine, for any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def shuffled_split(df: DataFrame, key: str, ids: list[str], seed: int = 42) -> DataFrame:
    """split_by_position after a seeded shuffle of each key's rows; ids tell rows apart."""
    return split_by_position(df.withColumn("_order", seeded_order(ids, seed)), key, ["_order", *ids]).drop("_order")


def sampled_share(df: DataFrame, ids: list[str], ratio: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """max(1, n * ratio) rows of each key, or of all, the first of a seeded shuffle; rows are counted by ranges, none is put whole in order."""
    given = df.withColumn("_order", seeded_order(ids, seed)).withColumn("_stratum", F.col(key) if key else F.lit(1))
    rows = numbered(given, "_stratum", ["_order", *ids])
    return rows.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(ratio)))).drop("_order", "_stratum", "place", "total")
