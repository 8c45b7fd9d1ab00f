"""Seeded samples of strata, quotas over different supplies, and filling up to a budget; the same rows for any partitioning.

A row's place in its stratum is that of the hash of its id, so a sample is the k smallest hashes, whatever order rows come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A 64-bit hash shifted to be at least zero, as a share of its range.
_RANGE = 2.0**64
#: Rows of a stratum up to which every task keeps its own smallest; Spark does so below 1,000.
FEW = 500


def sample_hash(ids: list[str], seed: int = 42) -> Column:
    return F.xxhash64(*ids, F.lit(seed))


def _share(h: Column) -> Column:
    return h.cast("double") / F.lit(_RANGE) + F.lit(0.5)


def bottom_k(rows: DataFrame, strata: list[str], ids: list[str], k: int | Column, seed: int = 42) -> DataFrame:
    """The k rows of each stratum with the smallest hash of their ids, ties by the ids; k is a number or a column of strata.

    A number up to FEW takes one pass: each task keeps the k smallest of its rows' strata, and only these are shuffled.
    Else strata are counted by a plain aggregate; a row can only be among the k smallest if its hash lies below a bound that
    follows from k and the count, so all but about k rows of a stratum go before anything is ranked, and a stratum with
    a third of all rows needs no task of its own. Where chance leaves fewer than k below the bound, the stratum is
    ranked as a whole; that has a probability below 10^-9 for each. Null strata are a stratum; k null or below 1 takes none.
    """
    if isinstance(k, int) and k <= FEW:
        hashed = rows.withColumn("_h", sample_hash(ids, seed))
        if not strata:
            return hashed.orderBy("_h", *ids).limit(max(k, 0)).select(*rows.columns)
        return hashed.withColumn("_place", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", *ids))).where(F.col("_place") <= k).select(*rows.columns)
    h, wanted = sample_hash(ids, seed), (F.lit(k) if isinstance(k, int) else k).cast("double")
    sized = rows.withColumn("_h", h).withColumn("_k", F.coalesce(wanted, F.lit(0.0))).where("_k >= 1")
    names = [f"_s_{s}" for s in strata]
    total = sized.groupBy(*[F.col(s).alias(n) for s, n in zip(strata, names)], F.col("_k").alias("_want")).agg(F.count("*").alias("_n"))
    total = total.withColumn("_bound", (F.col("_want") + 7 * F.sqrt("_want") + 25) / F.col("_n"))
    alike = lambda to: [F.col(s).eqNullSafe(F.col(f"{to}_{s}")) for s in strata]
    one = not strata and isinstance(k, int)  # a single row then
    met = sized.join(F.broadcast(total) if one else total, [*alike("_s"), F.col("_k") == F.col("_want")])
    under = _share(F.col("_h")) < F.col("_bound")
    counts = met.groupBy(*names, "_want").agg(F.count_if(under).alias("_met"), F.first("_n").alias("_n")).where(F.col("_met") < F.least("_want", F.col("_n").cast("double")))
    whole = counts.select(*[F.col(n).alias(f"_w_{s}") for s, n in zip(strata, names)], F.col("_want").alias("_w"), F.lit(True).alias("_whole"))
    kept = met.join(F.broadcast(whole) if one else whole, [*alike("_w"), F.col("_k") == F.col("_w")], "left").where(under | F.coalesce("_whole", F.lit(False)))
    order = Window.partitionBy(*strata, "_k").orderBy("_h", *ids)
    return kept.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= F.col("_k")).select(*rows.columns)


def quotas(supplies: DataFrame, key: str, total: int, supply: str = "supply", by: list[str] | None = None) -> DataFrame:
    """(by, key, quota): total dealt to the keys as evenly as their supplies allow, of each group on its own if by is given.

    Keys in order of their supply: once what is left, evenly dealt, is no more than a key's supply, that key and all
    after it get the even share; what doesn't divide goes to the first of them in order of supply and name. Prefix sums
    take the place of a loop over keys. Supplies below zero count as none; a null supply is none.
    """
    by = by or []
    s = F.greatest(F.coalesce(F.col(supply), F.lit(0)), F.lit(0)).cast("long")
    own = Window.partitionBy(*by).orderBy("_s", key)
    dealt = supplies.select(*by, key, s.alias("_s"))
    dealt = dealt.withColumn("_before", F.sum("_s").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    dealt = dealt.withColumn("_place", F.row_number().over(own)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    left, keys = F.greatest(F.lit(total) - F.coalesce("_before", F.lit(0)), F.lit(0)), F.col("_n") - F.col("_place") + 1
    dealt = dealt.withColumn("_left", left).withColumn("_open", F.col("_s") * keys >= F.col("_left"))
    first = F.min(F.when(F.col("_open"), F.struct("_place", F.col("_left").alias("left"), keys.alias("keys")))).over(Window.partitionBy(*by))
    dealt = dealt.withColumn("_first", first)
    share, rest = F.floor(F.col("_first.left") / F.col("_first.keys")), F.col("_first.left") % F.col("_first.keys")
    late = F.col("_first").isNotNull() & (F.col("_place") >= F.col("_first._place"))
    extra = (F.col("_place") - F.col("_first._place") >= F.col("_first.keys") - rest).cast("long")
    return dealt.select(*by, key, F.when(late, share + extra).otherwise(F.col("_s")).cast("long").alias("quota"))


def filled(have: DataFrame, pool: DataFrame, budget: DataFrame, category: str, ids: list[str], seed: int = 42) -> DataFrame:
    """have, and rows of pool up to budget(category, n) in each category: those with the smallest hash of their ids that have doesn't hold.

    Categories without a budget stay as they are; a pool with fewer rows than are lacking gives all it has.
    """
    lacking = budget.join(have.groupBy(category).agg(F.count("*").alias("_have")), category, "left").select(category, (F.col("n") - F.coalesce("_have", F.lit(0))).alias("_lack")).where("_lack > 0")
    new = pool.join(have.select(*ids).distinct(), ids, "left_anti").dropDuplicates(ids).join(lacking, category)
    return have.unionByName(bottom_k(new, [category], ids, F.col("_lack"), seed).select(*have.columns))


def generated(supplies: DataFrame, pool: DataFrame, template: str, ids: list[str], total: int, seed: int = 42) -> DataFrame:
    """Rows of pool for each template, as many as quotas() of supplies(template, supply) deals it: total questions over templates that can give different numbers."""
    dealt = quotas(supplies, template, total)
    return bottom_k(pool.join(dealt, template), [template], ids, F.col("quota"), seed).drop("quota")
