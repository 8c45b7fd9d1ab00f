"""Secret scans against Python's regexes over every text."""

import hashlib
import random
import re

from factloom.llm import queries, secrets
from factloom.llm.secret_rules import BASE, RULES, trigram_query


def brute(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "", re.ASCII) if len(m.group(group)) >= least]
    return sorted(out)


def lines(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


PIECES = [
    "password: hunter22", "PassWD='abc'", 'api_key = "QWERTY/+=_-."', "apikey:short", "token=token=abcdef secret:", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 10, "0123456789abcdef" * 2, "deadbeef", "ghp_" + "a1B2" * 9,
    "glpat-" + "x" * 20, "xoxb-123456789012", "sk_live_" + "Z" * 16, "AIza" + "q" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "-----BEGIN RSA PRIVATE KEY-----", "npm_" + "k" * 36, "pypi-AgE" + "p" * 32, "SG." + "s" * 20 + "." + "t" * 30,
    "Bearer " + "b" * 24 + "==", "ftp://me:pass@host.example", "plain words", "é 日本 😀", "\n", "  ", "TOKEN", "secret   =   value99", "f" * 23, "f" * 24,
]


def test_spans_match_python(spark):
    rng = random.Random(12)
    texts = PIECES + [rng.choice(["", " ", "\n", "é"]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(150)] + [None, "", "token=abcdef1 " * 2000, "a" * 50000]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "password=nullid", 1), (3, "secret=again11", 1), (3, "nothing", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules int")
    got = secrets.scan(docs).collect()
    assert len(got) == len(rows) and got[0].rules
    for r in got:
        assert [tuple(s) for s in r.spans] == brute(r.text), r.text
    for r in secrets.digest(docs).collect():
        if r.doc_id not in (None, 3):
            want = brute(texts[r.doc_id])
            assert r.spans == lines(want) and r.base_sha256 == hashlib.sha256(lines([s for s in want if s[1] < BASE]).encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
    assert secrets.scan(docs.limit(0)).collect() == []


def test_masking(spark):
    docs = spark.createDataFrame([(1, "é token = abcdef12 end"), (2, "clean"), (3, "secret=" + "0a" * 15)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.t for r in secrets.scan(docs).select("doc_id", secrets.masked(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [SECRET] end", 2: "clean", 3: "[SECRET]"}


def test_queries_hold_wherever_the_regex_matches():
    for piece in PIECES:
        for _, pattern, _, _ in RULES:
            if re.search(pattern, piece, re.ASCII):
                low = piece.lower()
                assert all(any(all(t in low for t in a) for a in group) for group in trigram_query(pattern))
    assert trigram_query(RULES[2][1]) == [] and trigram_query(RULES[1][1]) == [[["aki", "kia"]]]


def test_whole_table_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(f"select doc_id, n_assign, n_access, n_hex, base_sha256, spans from ({queries.oracle_sql()['op9_secrets']})").fetchall()
    assert sorted(map(tuple, queries.op9_secrets(spark, sf).collect())) == sorted(want)
