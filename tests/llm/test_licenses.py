"""License scans against plain Python over every text."""

import random
import re

from factloom.llm import license_rules, licenses, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    base = sorted((i, label) for p, label in license_rules.BASE for v in [p.split()] for i in range(len(w)) if w[i : i + len(v)] == v)
    spaced = "".join(f" {x} " for x in w)
    found = []
    if re.search(licenses.PREFILTER, text or "", re.ASCII):
        for rank, (keyword, regex, label, weight) in enumerate(license_rules.rules()):
            if keyword in spaced:
                for m in re.finditer(regex, spaced):
                    s = spaced[: m.start()].count(" ") // 2
                    found.append((s, -s - m.group().count(" ") // 2, rank, label, weight))
    upto, labels, score = 0, set(), 0.0
    for s, back, _, label, weight in sorted(found):
        if -back > upto:
            upto = -back
            labels.add(label)
            score = max(score, weight)
    names = {label for _, label in base}
    return (len(w), len(base), base[0][0] if base else None, max(i for i, _ in base) if base else None, ",".join(sorted(names)), ",".join(sorted(names | labels)), 1.0 if base else score)


PIECES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "CC-BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3.", "the mit license the MIT licence", "GPLv3 license", "SPDX-License-Identifier: BSD-3-Clause",
    "All rights reserved.", "dedicated to the public domain", "mozilla public license 2.0", "available under a Creative Commons Attribution NonCommercial license", "the new bsd license", "plain", "é 日本 words", "Apache", "license", "cc", "by", "nc", "the", "mit", "\n", "version 2",
]


def test_matches_plain_python(spark):
    rng = random.Random(3)
    texts = PIECES + [rng.choice([" ", "\n", ", "]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 10))) for _ in range(120)] + [None, "", "...", "the mit license " * 800, "x" * 60000]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "text as key", "'z' as labels", "1 as base")
    rows = licenses.scan(docs).collect()
    want = [brute(t) for t in texts]
    assert sorted(map(repr, (tuple(r)[1:] for r in rows))) == sorted(map(repr, want))
    assert {r.doc_id: tuple(r)[1:] for r in rows if r.doc_id} == {i: w for i, w in enumerate(want) if i % 9}
    assert licenses.scan(docs.limit(0)).collect() == []


def test_rules():
    rules = license_rules.rules()
    assert len(rules) > 200
    for keyword, regex, _, _ in rules:
        assert not re.search(regex, "") and len(keyword) > 2


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_licenses(spark, sf).collect()
    assert len(rows) == len(texts) and all(tuple(r)[1:] == brute(texts[r.doc_id]) for r in rows)


def test_every_rule_passes_the_prefilter(spark, monkeypatch):
    shortest = [re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", re.sub(r"\(\?:[^)]*\)\?", "", regex)) for _, regex, _, _ in license_rules.rules()]
    notices = {
        "released under the MIT": "mit", "distributed under GPL 2": "gpl-2", "available under Creative Commons Attribution": "cc-by", "published under the terms of the Apache 2.0": "apache-2",
        "GPL v3 license": "gpl-3", "MPL v2.0 license": "mpl-2", "EUPL v1.2 license": "eupl-1.2", "GPL v 3 license": "gpl-3", "licensed under the GNU General Public License v2": "gpl-2", "under glass": "",
    }
    texts = [*notices, *shortest]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    monkeypatch.setattr(licenses, "PREFILTER", "")
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]
    assert [got[i][5] for i in range(len(notices))] == list(notices.values())
    assert all(got[i][5] for i in range(len(notices), len(texts)))


def test_every_sentence_has_its_label(spark):
    plain = lambda words: re.sub(r"\(([^|)]*)[^)]*\)!", r"\1", re.sub(r"\([^)]*\)(?!!)", "", words))
    rows = [(i, f"One two. {plain(words).capitalize()}; three.") for i, (_, _, words, _) in enumerate(license_rules.SENTENCES)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, keyword, words, _) in enumerate(license_rules.SENTENCES):
        assert keyword in plain(words).split() and got[i].score > 0 and got[i].labels, words
        assert got[i].n_base or tuple(got[i])[1:] == brute(rows[i][1]), words
    assert sum(label in got[i].labels.split(",") for i, (label, *_) in enumerate(license_rules.SENTENCES)) >= 90


def test_base_phrases_are_those_of_the_contract(spark):
    """Phrases and places by hand; every ASCII character and some beyond between and inside words."""
    rows = [(0, "under the MIT license"), (1, "read the mit license, under the Mit-LICENSE"), (2, "the mit license"), (3, "Apache License; version 2.0, CC BY-NC CC/BY NC 4")]
    signs = [chr(i) for i in range(1, 0x120)] + ["\u2028", "\u212a", "\u00a0", "\U0001f600", "\ud7ff", "\uffff"]
    rows += [(10 + i, f"x{c}under{c}the{c}mit{c}license{c}cc by nc{c}") for i, c in enumerate(signs)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(got[i])[1:6] for i in range(4)] == [(4, 1, 0, 0, "mit"), (8, 1, 4, 4, "mit"), (3, 0, None, None, ""), (12, 3, 0, 8, "apache-2,cc-by-nc")]
    for i, text in rows[4:]:
        w = words(text)
        found = sorted((k, label) for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for v in [p.split()] for k in range(len(w)) if w[k : k + len(v)] == v)
        assert tuple(got[i])[1:6] == (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({label for _, label in found}))), repr(text)
