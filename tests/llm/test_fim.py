"""Fill-in-the-middle documents against plain Python, and the boundary set against a sorted list."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from factloom.llm import fim, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
UNITS = {"token": TOKEN.findall, "char": list, "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}
ODD = ["", None, " ", "word", "two words", "  lead and trail \n", "日本語 😀 ñ x", "has <P> mark", "has <S>", "<M>", "a<" * 30, "x\x0b\x0cy\x1cz", "<P", "P> <S <", "word " * 40_000, "z" * 70_000]


def brute(doc_id, text, unit="token", moved=50, suffix_first=80, seed=42):
    text = text or ""
    parts = UNITS[unit](text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(parts)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(parts[:x]), "".join(parts[x:y]), "".join(parts[y:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= moved:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["token", "char", "line"])
@pytest.mark.parametrize("moved,suffix_first", [(50, 80), (100, 0), (100, 100)])
def test_matches_plain_python(spark, unit, moved, suffix_first):
    rows = list(enumerate(ODD * 2)) + [(None, "no id here"), (3, "an id\nagain"), (3, "an id\nagain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as form", "2 as n", "'x' as cut")
    made = fim.transform(docs, moved=moved, suffix_first=suffix_first, unit=unit)
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(made.output, made.form).alias("back"), "text").collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted((brute(i, t, unit, moved, suffix_first) for i, t in rows), key=repr)
    assert all(r.back == r.text for r in found)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    frame = queries.op13_fim(spark, sf)
    found = sorted(map(tuple, frame.collect()))
    want = [brute(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == sorted((*w[:5], sha(w[5]), sha(texts[w[0]])) for w in want)
    sql = duckdb.sql(f"WITH documents AS (SELECT * FROM '{sf}/documents.parquet') SELECT {', '.join(frame.columns)} FROM ({fim.digest_sql()})").fetchall()
    assert found == sorted(sql)


def test_boundary_set_selects_as_a_sorted_list():
    rng = np.random.default_rng(7)
    dense = np.flatnonzero(rng.random(150_000) < 0.4)
    for offsets in (np.arange(0), np.array([0]), np.array([5, 65535, 65536, 9_000_000]), np.arange(200_000), dense, np.arange(0, 400_000, 50), np.concatenate([np.arange(10, 5000), 70_000 + dense, [900_001]])):
        own = fim.BoundarySet(offsets)
        assert len(own) == len(offsets)
        for k in {0, len(offsets) // 2, len(offsets) - 1, *rng.integers(0, max(1, len(offsets)), 200).tolist()}:
            if 0 <= k < len(offsets):
                assert own.select(k) == offsets[k]
        with pytest.raises(IndexError):
            own.select(len(offsets))
    assert {kind for kind, _ in fim.BoundarySet(dense).containers} == {"bitmap"} and fim.BoundarySet(np.arange(70_000)).containers[0][0] == "runs" and fim.BoundarySet(np.arange(0, 900, 3)).containers[0][0] == "array"


def test_empty_table_and_unknown_unit(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digest(empty).collect() == []
    with pytest.raises(ValueError):
        fim.transform(empty, unit="page")
