"""Removed repeats against a plain dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import queries, repeats


def brute(rows):
    """(doc_id, n_words, n_removed, spans, kept) of rows in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - repeats.WINDOW + 1):
            window = tuple(words[i : i + repeats.WINDOW])
            if window in seen:
                gone[i : i + repeats.WINDOW] = [True] * repeats.WINDOW
            seen.add(window)
        edges = [i for i in range(len(words) + 1) if (i < len(words) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((doc_id, len(words), sum(gone), list(zip(edges[::2], edges[1::2])), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def got(frame):
    return [(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in frame.collect()]


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["ß", "日本", "a\x00b", "É"]
    phrase = [" ".join(rng.choice(vocab) for _ in range(rng.choice((10, 19, 20, 21, 60)))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(phrase))
        texts.append(rng.choice((" ", "\n", " \t ")).join(parts))
    texts += [texts[3], texts[3], texts[7] + " tail", "head " + texts[7], " ".join(["go"] * 100), " ".join(["go", "up"] * 60), " ".join(["go"] * 19), None, "", "   ", " ".join(texts[:30])]
    return texts


@pytest.mark.parametrize("block,automaton", [(4_000_000, 600_000), (1500, 70), (6000, 500)])
def test_matches_all_windows(spark, monkeypatch, block, automaton):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(repeats, "AUTOMATON_WORDS", automaton)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 20_000)
    texts = corpus(4)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").selectExpr("*", "1 as block", "2 as place", "3 as window")
    found = sorted(got(repeats.remove(docs)))
    want = brute(rows)
    assert found == want
    assert sum(r[2] for r in want) > 1000


def test_repeated_ids_and_nulls(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(30)) for p in "xy")
    docs = spark.createDataFrame([(5, a), (5, a), (5, b), (None, b), (None, a + " " + b), (4, "z " + a), (None, None)], "doc_id long, text string")
    found = sorted(((d, n, k) for d, n, k, _, _ in got(repeats.remove(docs))), key=repr)
    assert found == sorted([(4, 31, 0), (5, 30, 30), (5, 30, 30), (5, 30, 0), (None, 30, 30), (None, 60, 60), (None, 0, 0)], key=repr)


def test_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, _, t in brute(rows)]
    assert sorted(map(tuple, queries.op12_repeats(spark, "/root/testdata/sf0.001").collect())) == want
    assert any(k for _, _, k, _ in want)


def test_empty_table(spark):
    assert repeats.remove(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_text():
    rng = random.Random(2)
    base = " ".join(str(rng.randint(0, 5000)) for _ in range(150_000))
    docs = pa.table({"block": [0, 0], "place": [0, 1], "doc_id": [1, 2], "text": [base, "x " + base]})
    out = repeats._kept(docs, pa.table({"block": pa.array([], pa.int64()), "anchor": pa.array([], pa.int64()), "window": pa.array([], pa.int64())}))
    assert out["n_removed"].to_pylist() == [0, 150_000] and out["kept"].to_pylist() == [base, "x"]


def test_windows_of_equal_words_share_their_anchor():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 4000).astype(str)
    found = repeats.Windows(pa.array([" ".join(words), " ".join(words[100:3000]), "too short"]))
    by = {}
    for i, (s, h, a, at) in enumerate(zip(found.start, found.hash, found.anchor, found.at)):
        key = tuple(found.index[s : s + repeats.WINDOW])
        assert by.setdefault(key, (h, a, at - s)) == (h, a, at - s)
        assert s <= at <= s + repeats.WINDOW - repeats.ANCHOR
    assert len({v[0] for v in by.values()}) == len(by)
