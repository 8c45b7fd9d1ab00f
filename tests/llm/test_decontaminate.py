"""Decontamination against all windows of all documents."""

import random
import re
from collections import Counter

import numpy as np

from factloom.llm import decontaminate, queries


def words(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            b, n = shingles(v), min(len(v), len(w))
            for s in range(len(w) - n + 1) if v and w else ():
                if min(5, len(v)) != min(5, n):
                    continue
                a = shingles(w[s : s + n])
                value = sum((a & b).values()) / sum((a | b).values())
                if value >= 0.8 and value > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (s, value)
    return out


def test_matches_all_windows(spark):
    rng = random.Random(8)
    some = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choice(some) for _ in range(n))) for i, n in enumerate([1 + 59, 40, 25, 14, 9, 5, 3, 1, 60, 60])]
    items += [(50, items[0][1]), (51, ""), (52, None), (53, "a a a a a a a a a a a a"), (54, "RARE tokens Here")]
    docs = []
    for d in range(160):
        body = [rng.choice(some) for _ in range(rng.randint(0, 150))]
        passage = words(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if len(passage) > 3:
                p = rng.randrange(len(passage))
                passage[p : p + 1] = rng.choice([[], ["Edit"], ["x", "y"]])
        at = rng.randint(0, len(body))
        docs.append((d, " \n".join(body[:at] + passage + body[at:])))
    docs += [(900, ""), (901, None), (902, items[0][1].upper().replace("W", "w")), (903, " ".join(items[0][1].split()[:56])), (904, "a " * 30), (905, "x RARE tokens here y"), (None, items[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'s' as similarity")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 as doc_id")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.hits(frame, bench).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and len(want) > 60
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.hits(none, bench).collect() == [] and decontaminate.hits(one, bench.limit(0)).collect() == []
    assert [tuple(r) for r in decontaminate.hits(one, bench).collect()] == [(1, 1, 0, 1.0)]


def test_several_passes_find_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(queries.op3_decontaminate(spark, sf).collect())
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 7)
    assert whole and sorted(queries.op3_decontaminate(spark, sf).collect()) == whole


def test_tables_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(300)]
    items = decontaminate.Items([(i, " ".join(rng.choice(words, 30 if i % 3 else 12))) for i in range(90)])
    for size in (12, 30):
        own = np.flatnonzero(items.sizes == size)[::2]
        flips = [np.packbits(rng.random((1, decontaminate.BITS)) < p, axis=1).view(np.uint32)[0] for p in (0, 0.1, 0.2, 0.24, 0.25, 0.5) for _ in range(20)]
        window = np.array([items.prints[rng.choice(own)] ^ f for f in flips])
        far = np.bitwise_count(window[:, None] ^ items.prints[own][None]).sum(2)
        assert sorted(map(tuple, items.candidates(window, own).T.tolist())) == sorted(map(tuple, np.argwhere(far <= decontaminate.RADIUS).tolist()))
        assert 0 < (far <= decontaminate.RADIUS).sum() < far.size
