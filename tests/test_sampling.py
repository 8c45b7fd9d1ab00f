"""Bottom-k samples, quotas and fills against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import sampling


def hashes(spark, rows, seed=42):
    frame = spark.createDataFrame(rows, "g string, id long")
    return {(r.g, r.id): r.h for r in frame.select("g", "id", sampling.sample_hash(["id"], seed).alias("h")).collect()}


@pytest.mark.parametrize("k", [1, 3, 40])
def test_smallest_hashes_of_each_stratum(spark, k):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), i) for i in range(3000)]
    of = hashes(spark, rows)
    want = sorted((r for g in {g for g, _ in rows} for r in sorted((x for x in rows if x[0] == g), key=lambda x: (of[x], x[1]))[:k]), key=repr)
    for parts in (1, 7):
        frame = spark.createDataFrame(rows, "g string, id long").repartition(parts)
        assert sorted(map(tuple, sampling.bottom_k(frame, ["g"], ["id"], k).collect()), key=repr) == want
    everywhere = sampling.bottom_k(spark.createDataFrame(rows, "g string, id long"), [], ["id"], k).collect()
    assert {r.id for r in everywhere} == {i for _, i in sorted(rows, key=lambda x: (of[x], x[1]))[:k]}


def test_a_bound_that_is_too_low_is_made_good(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_share", lambda h: F.lit(2.0))
    rows = [("x", i) for i in range(50)] + [(None, 7)]
    of = hashes(spark, rows)
    frame = spark.createDataFrame(rows, "g string, id long")
    assert {(r.g, r.id) for r in sampling.bottom_k(frame, ["g"], ["id"], 4).collect()} == {*sorted(rows[:50], key=of.get)[:4], (None, 7)}
    assert {(r.g, r.id) for r in sampling.bottom_k(frame.where("g = 'x'"), [], ["id"], 4).collect()} == set(sorted(rows[:50], key=of.get)[:4])


def water(supplies, total):
    got = {k: 0 for k in supplies}
    while total > 0 and any(got[k] < s for k, s in supplies.items()):
        open_ = [k for k in supplies if got[k] < supplies[k]]
        if total < len(open_):
            return got, total, set(open_)
        for k in open_:
            got[k] += 1
        total -= len(open_)
    return got, 0, set()


def test_quotas_are_as_even_as_supplies_allow(spark):
    rng = random.Random(4)
    for total in (0, 1, 7, 40, 10_000):
        supplies = {f"t{i}": rng.choice((0, 1, 2, 5, 30, 31, 200)) for i in range(9)}
        frame = spark.createDataFrame([*supplies.items(), ("none", None)], "template string, supply long")
        dealt = {r.template: r.quota for r in sampling.quotas(frame, "template", total).collect()}
        base, rest, open_ = water(supplies, total)
        assert dealt.pop("none") == 0
        assert sum(dealt.values()) == min(total, sum(supplies.values()))
        more = {k for k in dealt if dealt[k] == base[k] + 1}
        assert all(dealt[k] == base[k] or k in more for k in dealt) and len(more) == rest and more <= open_


def test_fill_and_generated(spark):
    have = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "c string, id long")
    pool = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(20, 23)] + [("z", 90)], "c string, id long")
    budget = spark.createDataFrame([("a", 6), ("b", 50), ("z", 0)], "c string, n long")
    out = sampling.filled(have, pool, budget, "c", ["id"])
    n = {r.c: r["count"] for r in out.groupBy("c").count().collect()}
    assert n == {"a": 6, "b": 4} and out.select("id").distinct().count() == 10
    supplies = pool.groupBy("c").agg(F.count("*").alias("supply"))
    got = {r.c: r["count"] for r in sampling.generated(supplies, pool, "c", ["id"], 14).groupBy("c").count().collect()}
    assert got == {"a": 10, "b": 3, "z": 1}


def test_a_small_sample_reads_its_rows_once(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    for strata in (["g"], []):
        plan = sampling.bottom_k(rows, strata, ["id"], 4)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Range (0, 1000") == 1
