"""SimHash components against brute force."""

import random
import re

import xxhash

from factloom.llm import simhash


def brute_fp(text, k=3):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{row: smallest row reachable}, by all pairs."""
    to = list(range(len(fps)))

    def top(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                to[b] = a
    return [top(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_match_all_pairs(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        for _ in range(6):
            for bits in (1, 2, 3, 4, 5):
                g = f
                low, width = rng.choice([(0, 64), *simhash.BLOCKS])
                for b in rng.sample(range(low, low + width), bits):
                    g ^= 1 << b
                fps.add(g)
    fps = sorted(fps)
    want = brute_components(fps)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in simhash.connected_components(simhash.links(frame)).collect()}
    same, other = {}, {}
    for f, w in zip(fps, want):
        c = got.get(signed(f), signed(f))
        assert same.setdefault(w, c) == c
        assert other.setdefault(c, w) == w


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef Gh ij Kl mn ö é".split()) for _ in range(n)) for n in (1, 2, 3, 40, 200, 900)]
    texts = [*base, *base, None, "", " \t\n", base[4] + " tail", base[5] + " x", "x " + base[3], "é " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "'x' as component_id", "2 as key")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.components(docs).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == [signed(f) for f in fps]
    assert [got[i][1] for i in range(len(texts))] == brute_components(fps)


def test_empty_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(empty).collect() == []
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "other words altogether here")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def brute_groups(texts, similarity=0.8):
    """{row: smallest row that pairs of five-word shingle sets of that similarity connect}, by all pairs."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def near_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_near_duplicates_far_in_fingerprint_bits(spark, monkeypatch):
    rng = random.Random(11)
    some = ["w%d" % i for i in range(900)]
    texts = []
    for _ in range(60):
        words = [rng.choice(some) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        for _ in range(3):
            near = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 50))):
                near[rng.randrange(len(near))] = rng.choice(some)
            texts.append(" ".join(near))
    want = brute_groups(texts)
    assert sum((brute_fp(texts[i]) ^ brute_fp(texts[g])).bit_count() > 3 for i, g in enumerate(want)) > 30
    assert near_groups(spark, texts) == want
    passage = " ".join("p%d" % i for i in range(60))
    texts = [passage + " " + t if i % 2 else t for i, t in enumerate(texts)]
    monkeypatch.setattr(simhash, "OFTEN", 3)
    assert near_groups(spark, texts) == brute_groups(texts)


def test_near_duplicates_of_close_fingerprints_test_every_pair(spark):
    rng = random.Random(23)
    some = ["w%d" % i for i in range(900)]
    texts = []
    for repeats in (4, 6, 9, 200):
        for _ in range(12):
            passage = " ".join(rng.sample(some, 9)) + " "
            words = [rng.choice(some) for _ in range(150)]
            for _ in range(5):
                texts.append(passage * repeats + " ".join(words))
                at = rng.randrange(130)
                words = [*words[:at], *(rng.choice(some) for _ in range(rng.choice((6, 10, 18)))), *words[at + 18 :]]
            texts.append(passage * repeats + " ".join(rng.choice(some) for _ in range(150)))
    want = brute_groups(texts)
    assert want != list(range(len(texts))) and len(set(want)) > 48
    assert near_groups(spark, texts) == want


def test_a_large_group_of_near_copies_is_not_compared_by_all_pairs(spark, monkeypatch):
    """Copies of one text with edits at different places: few pairs are tested, and they connect what all pairs connect."""
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((2, 3))):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    to = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and to[i] != to[j]:
                low, high = sorted((to[i], to[j]))
                to = [low if t == high else t for t in to]
    tested, similar = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *more: (tested.append(pairs.distinct().count()), similar(pairs, *more))[1])
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(to))
    assert max(tested) <= 10 * len(texts)
