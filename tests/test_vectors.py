"""The inverted file and the tiled exact search against numpy."""

import numpy as np

from factloom import link_queries
from factloom.operators import vector_index


def made(spark, seed=3, n=1500, dim=24):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    m = centers[rng.integers(0, 12, n)] + rng.normal(scale=0.6, size=(n, dim))
    m[5:40] = m[5]  # a vector that many share
    m[41] = 0
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m.astype(np.float32))], "vec_id long, embedding array<float>"), m.astype(np.float32).astype(float)


def plain(m, ids, k):
    norm = np.linalg.norm(m, axis=1)
    out = {}
    for q in ids:
        score = np.round(np.divide(m @ m[q], norm * norm[q], out=np.zeros(len(m)), where=norm * norm[q] > 0), 6)
        order = [int(i) for i in np.lexsort((np.arange(len(m)), -score)) if i != q][:k]
        out[q] = [(i, float(score[i])) for i in order]
    return out


def rows(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_exact_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "TILE_ROWS", 100)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 7)
    v, m = made(spark)
    asked = v.where("vec_id % 50 = 0 OR vec_id = 41").selectExpr("vec_id AS query_id", "embedding")
    got, want = rows(vector_index.exact(v, asked, 10)), plain(m, [*range(0, 1500, 50), 41], 10)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found] and np.allclose([s for _, s in got[q]], [s for _, s in found], atol=2e-6)


def test_index_recall_and_fallback(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "TILE_ROWS", 200)
    v, m = made(spark)
    index = vector_index.build(v, vector_index.fit(v))
    assert index.codes.count() == 1500 and len(index.centers) <= 40
    asked = v.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")
    truth = {q: {i for i, _ in found} for q, found in plain(m, range(0, 1500, 50), 10).items()}
    got = rows(vector_index.search(index, v, asked, 10))
    assert all(len(found) == 10 for found in got.values()) and got.keys() == truth.keys()
    assert np.mean([len({i for i, _ in got[q]} & truth[q]) / 10 for q in truth]) >= 0.9
    some = asked.where("query_id IN (100, 250)")
    assert all(len(found) == 900 for found in rows(vector_index.search(index, v, some, 900, probes=1)).values())  # one cell hasn't so many: all cells are asked
    away = v.where("vec_id IN (1, 2)").selectExpr("vec_id * 50 + 50 AS query_id", "embedding")
    assert all(len(found) == 900 for found in rows(vector_index.search(index, v, some, 900, 1, away)).values())


def test_reranked_and_cut(spark):
    v, m = made(spark, n=300)
    index = vector_index.build(v, vector_index.fit(v, cells=4))
    asked = v.where("vec_id = 100").selectExpr("vec_id AS query_id", "embedding")
    near = [i for i, _ in rows(vector_index.search(index, v, asked, 6, probes=4))[100]]
    given = spark.createDataFrame([(100, near[4], 9.0), (100, near[2], 8.0)], "query_id long, vec_id long, score double")
    assert [i for i, _ in rows(vector_index.retrieve(index, v, asked, 6, 3, given, probes=4))[100]] == [near[4], near[2], near[0]]
    assert [i for i, _ in rows(vector_index.retrieve(index, v, asked, 6, 2, probes=4))[100]] == near[:2]


def test_empty_tables(spark):
    v, _ = made(spark, n=60)
    none = v.where("false")
    asked = v.where("vec_id = 3").selectExpr("vec_id AS query_id", "embedding")
    index = vector_index.build(none, vector_index.fit(none))
    assert vector_index.search(index, none, asked, 3).collect() == [] and vector_index.exact(none, asked, 3).collect() == []
    assert vector_index.exact(v, asked.where("false"), 3).collect() == []


def test_query_reaches_the_recall_it_asks_for(spark):
    sf = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    m = np.array([r.embedding for r in v.orderBy("vec_id").collect()], np.float32).astype(float)
    ids = [r.vec_id for r in v.orderBy("vec_id").collect()]
    assert ids == list(range(len(m)))
    truth = {q: {i for i, _ in found} for q, found in plain(m, range(0, len(m), 50), 10).items()}
    got = rows(link_queries.vector_topk_index(spark, sf))
    assert got.keys() == truth.keys() and all(len(f) == 10 for f in got.values())
    assert np.mean([len({i for i, _ in got[q]} & truth[q]) / 10 for q in truth]) >= 0.9
