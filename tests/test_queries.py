"""Every query with SQL against that SQL, at the smallest size."""

import datetime
import decimal
import os

import duckdb
import pytest

from factloom import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and v == int(v):
        v = int(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
    got = frame.select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def test_entry(spark):
    rows = queries.entry(spark, SF).collect()
    assert rows and sum(r.most for r in rows) == 1


def test_pairs_of_suppliers_are_derived_by_many_tasks(spark, monkeypatch):
    from factloom.plans import facts

    sf = "/root/testdata/sf0.01"
    whole = facts.derived(spark, sf)
    monkeypatch.setattr(facts, "_PAIRS", 60)
    spread = facts.derived(spark, sf)
    for name in ("neighbors", "xconnects"):
        assert sorted(map(repr, spread[name].collect())) == sorted(map(repr, whole[name].collect()))
        used = spread[name].select(spark_partition()).distinct().count()
        assert used > whole[name].select(spark_partition()).distinct().count() and used > 2


def spark_partition():
    from pyspark.sql import functions as F

    return F.spark_partition_id()
