"""Personal data: base spans against Python's plain patterns, discovery against a plain loop."""

import hashlib
import random
import re
from collections import Counter

from factloom.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    return sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if holds(kind, m.group()))


def lines(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


PIECES = [
    "a.b@c.d", "x@y", "a@b.c_d@e.f", "me+1@mail-2.example.co.uk.", "@@a@b.c", "1.2.3.4", "256.1.1.1", "001.02.3.0004", "1.2.3.4.5.6.7.8", "9999999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "5500000000000004",
    "+1 (743) 555-3824", "+49.30.1234567", "+1 23", "+12345678901234567", "+1 555 123 4567 890", "é", "日本", "😀", "\n", "word", "12", "3 4 5 6", "- -", "a" * 40 + "@", "1" * 30,
]


def test_base_spans_match_python(spark):
    rng = random.Random(21)
    texts = PIECES + [rng.choice(["", " ", "\n", "-", "."]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(200)] + [None, "", "a.b@c.d " * 1500, "a." * 30000 + "@b.c", "1" * 40000, "x@" + "a." * 20000 + "b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "p@q.r"), (0, "a.b@c.d")], "doc_id long, text string").selectExpr("*", "1 as row_no", "'v' as spans")
    got = pii.digest(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id:
            want = brute(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(lines(want).encode()).hexdigest(), texts[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
            assert set(lines(want).split(",")) <= set(r.spans.split(",")) | {""}
    assert pii.digest(docs.limit(0)).collect() == []


def corpus():
    rng = random.Random(4)
    some = [("w" + chr(97 + i)) * 2 for i in range(20)]
    filler = lambda: " ".join(rng.choice(some) for _ in range(6))
    texts = [f"{filler()} please call me +1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} today {filler()}" for _ in range(40)]
    texts += [f"{filler()} please call me 555-867-5309 today {filler()}", f"{filler()} order id 555-111-2222 shipped {filler()}", f"{filler()} please call me maybe {filler()}"]
    texts += [f"{filler()} order id {rng.randint(1000000, 9999999)} shipped {filler()}" for _ in range(10)]
    return texts


def test_contexts_discover_new_forms(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    new = {i: s for i, s in got.items() if "ctx_" in s}
    at = texts[40].index("555-867")
    assert new == {40: f"ctx_phone:{at}:{at + 12}"}


def plain_loop(found):
    """The phones that discover() accepts."""

    def patterns(o):
        return ["< " + o.two] * (" " in o.two) + ["- " + o.one] * (o.one != "") + [f"= {o.one} _ {o.next}"] * (o.one != "" and o.next != "")

    edges = {(o.kind if o.kind != "other" else None, o.value, p) for r in found for o in [*r.base, *r.other] for p in patterns(o)}
    fits = lambda v: bool(re.fullmatch(r"\W*[0-9(). -]+\W*", v) and re.search(r"[0-9][(). -]+[0-9]", v) and 7 <= len(re.sub(r"\D", "", v)) <= 15)
    size, sure = Counter(p for _, _, p in edges), Counter((p, k) for k, _, p in edges if k)
    apt = Counter((p, "phone") for k, v, p in edges if not k and fits(v))
    able = {pk for pk in apt if sure[pk] + apt[pk] >= max(pii.LEAST_SEEDS, pii.LEAST_TRUST * (size[pk[0]] + pii.DOUBT))}
    new = {(v, p) for k, v, p in edges if not k and fits(v) and (p, "phone") in able}
    mean = lambda x: sum(x) / len(x)
    accepted = set()
    for _ in range(pii.ROUNDS):
        seeds = {p: sure[p, k] + sum(q == p and v in accepted for v, q in new) for p, k in able}
        trust = {p: n / (size[p] + pii.DOUBT) for p, n in seeds.items() if n >= pii.LEAST_SEEDS}
        score = {v: mean([trust[q] for w, q in new if w == v and q in trust]) for v, p in new if v not in accepted and p in trust}
        trust = {p: t + sum(score.get(v, 0) for v, q in new if q == p) / (size[p] + pii.DOUBT) for p, t in trust.items()}
        of = {v: [trust[q] for w, q in new if w == v and q in trust] for v, p in new if p in trust}
        accepted |= {v for v, t in of.items() if mean(t) >= pii.LEAST_TRUST and (sum(y >= pii.LEAST_TRUST for y in t) >= pii.LEAST_PATTERNS or max(t) >= pii.ALONE)}
    return accepted


def test_scores_match_a_plain_loop(spark):
    for texts in (corpus(), second_hand()):
        frame = pii.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        want = plain_loop(frame.collect())
        assert want and {tuple(r) for r in pii.discover(frame).collect()} == {(v, "phone") for v in want}


def second_hand():
    """Five numbers in a form that base patterns miss stand where base matches stand, and in a context of their own that holds a sixth."""
    rng = random.Random(12)
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(4))
    texts = [f"{filler()} reach me on +1 (555) 867-{1000 + i} soon {filler()}" for i in range(60)]
    texts += [f"{filler()} reach me on (555) 222-{1000 + i} soon {filler()}" for i in range(5)]
    texts += [f"{filler()} ring desk (555) 222-{1000 + i} now {filler()}" for i in range(5)]
    return [*texts, f"{filler()} ring desk (555) 333-9999 now {filler()}", f"{filler()} part no 555 333 9998 {filler()}"]


def test_accepted_instances_induce_patterns(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(second_hand())), "doc_id long, text string")
    got = {r.value for r in pii.discover(pii.occurrences(docs)).collect()}
    assert got == {f"(555) 222-{1000 + i}" for i in range(5)} | {"(555) 333-9999"}
    monkeypatch.setattr(pii, "ROUNDS", 1)
    assert {r.value for r in pii.discover(pii.occurrences(docs)).collect()} == got - {"(555) 333-9999"}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(lines(brute(texts[r.doc_id])).encode()).hexdigest()
