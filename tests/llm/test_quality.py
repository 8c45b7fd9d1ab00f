"""Quality rules: counts against brute force, the model against plain counting, bands that reject what stands out."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from factloom.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            marked |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


ODD = [None, "", " \n\n ", "a", "a\na\n a\n\n\na", "x y z w v x y z w v x y z", "日本 語 😀 é", "w " * 4000, "#*$%&|<> <>", "a b c d e\na b c d e\r\nA b c d e", "\x1c \x85 \x0b"]


def test_counts_match_brute_force(spark):
    rng = random.Random(6)
    texts = ODD + [" \n"[rng.randrange(2)].join(rng.choice("a b c d E # f% g".split()) for _ in range(rng.randint(1, 80))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "'k' as kept", "2 as low")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_model_matches_plain_counting(spark):
    learned = ["the cat sat on the mat, the cat ran.", "a mat and a cat and the hat"] * 3 + ["thin hats that sit at the inn"]
    rows = [("en", t, True) for t in learned] + [("en", "the café 😀 hat", False), ("de", "xx", False)]
    counts = Counter()
    for lang, t, own in rows:
        points, cuts = quality.code_points(pa.array([t]))
        for g in quality.grams(points, cuts).tolist():
            counts[lang, g, own] += 1
    keys = {(lang, g) for lang, g, _ in counts}
    frame = spark.createDataFrame([(lang, g, counts[lang, g, True] + counts[lang, g, False], counts[lang, g, True]) for lang, g in keys], "lang string, gram long, n long, own long")
    got = {(r.lang, r.gram): r.logp for r in quality.kneser_ney(frame).collect()}
    assert set(got) == keys
    # plain recursion over dictionaries
    chars = lambda g: tuple(g >> 16 * k & 0xFFFF for k in (3, 2, 1, 0))
    tables = [Counter({chars(g): n for (lang, g, own), n in counts.items() if own})]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))
    tables.reverse()
    followers = []
    for table in tables:
        by = defaultdict(dict)
        for g, n in table.items():
            by[g[:-1]][g[-1]] = n
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]] if n[1] and n[2] and n[3] else [0.5, 0.75, 1.0]
        followers.append((by, [0] + [min(max(x, 0.01), top) for x, top in zip(raw, (1, 1.99, 2.99))]))

    def p(g):
        if not g:
            return 1 / 65536
        by, d = followers[len(g) - 1]
        seen = by.get(g[:-1])
        if not seen:
            return p(g[1:])
        n = seen.get(g[-1], 0)
        return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in seen.values()) * p(g[1:])) / sum(seen.values())

    for lang, g in keys:
        assert math.isclose(math.exp(got[lang, g]), p(chars(g)) if lang == "en" else 1 / 65536, rel_tol=1e-9)


def test_bands_reject_both_ends_by_language(spark):
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    clean = {lang: [" ".join(word(letters) for _ in range(150)) for _ in range(60)] for lang, letters in (("en", "aeinrst"), ("de", "eghlmuz"))}
    rows = [(lang, t) for lang in clean for t in clean[lang]]
    odd = [("en", "".join(chr(rng.randint(33, 0x2FF)) + " " * (rng.random() < 0.2) for _ in range(900))), ("de", " ".join("e" * n for n in range(1, 120))), ("en", clean["de"][0])]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows + odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(got[i] for i in range(len(rows)))
    assert not any(got[len(rows) + i] for i in range(len(odd)))


def test_several_passes_and_empty(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(queries.op4_quality(spark, sf).collect())
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count()
    monkeypatch.setattr(quality, "MODEL_ROWS", 5000)
    for got, want in zip(sorted(queries.op4_quality(spark, sf).collect()), whole, strict=True):
        assert got[:-1] == want[:-1] and (got.perplexity is None or math.isclose(got.perplexity, want.perplexity, rel_tol=1e-9))
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_kept_follows_the_stated_bands(spark):
    """kept again, from each row's counts and perplexity: medians and quartiles of the plain texts by language."""
    rows = [r for r in quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()]
    values = defaultdict(list)
    for r in rows:
        if r.plain and r.log_perplexity is not None:
            values[r.lang].append(math.floor(r.log_perplexity * 1000 + 0.5))
    rejected = 0
    for r in rows:
        x = sorted(values[r.lang])
        a, m, b = (x[max(0, math.ceil(q * len(x) - 1e-9) - 1)] / 1000 for q in (0.25, 0.5, 0.75))
        reach = max(b - a, 0.01) * math.sqrt(1 + quality.SHORT_CHARS / max(r.n_chars, 1))
        inside = r.log_perplexity is None or m - quality.BELOW * reach <= r.log_perplexity <= m + quality.ABOVE * reach
        assert r.kept == (not r.base_failed and inside)
        rejected += not r.base_failed and not inside
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert rejected > 40 and sum(k for y, k in judged if not y) <= 0.1 * sum(not y for y, _ in judged)
    assert sum(not k for y, k in judged if y) <= 0.01 * sum(y for y, _ in judged)
