"""Aligned tokens and pair counts against plain loops over tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "Hello wörld, it's 12345!", "  two  blanks ", "日本語 テキスト 😀😀 é", "x<|endoftext|>y <unk> <s> <0x41>", "▁ x", "\n\n\ttab\r\n", "z" * 5000, "ab " * 4000,
    "Hello wörld, it's 12345!", "ﬁ ½ Ⅷ é", "́ lone", "word " * 12000, "ñandú ǅ ß ​   end", "tokenization alignment of subwords",
]


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each text."""
    library, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    back = {c: b for b, c in enumerate(alignment._byte_chars())}
    spell_b = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    found, docs = [], Counter()
    for text in texts:
        a = [(i, bytes(back[c] for c in library.id_to_token(i))) for i in library.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, spell_b(i)) for i in pieces.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
            i, j = x, y
        links = Counter()
        for ga, gb in groups:
            for x, n in Counter(ga).items():
                for y, m in Counter(gb).items():
                    links[x, y] += n * m
        docs.update(links.keys())
        found.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for na, nb, groups, links in found:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if docs[p] == top[p[0]])
        out.append((na, nb, len(groups), sum(links.values()), best, sum(n * docs[p] for p, n in links.items()), hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return out


def test_odd_texts_match_plain_loops(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "1 as block", "'x' as pairs", "2 as n_a")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, A, B).collect()}
    want = brute(ODD)
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert got[i] == want[i], repr(t)[:60]
    assert want[4][2] > 5 and want[8] == (0, 0, 0, 0, 0, 0, "")


def test_whole_table_matches_plain_loops(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows]))}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_blocks_repeated_rows_and_nulls(spark, monkeypatch):
    texts = ["one two three", "one two", "", None, "tree house three"] * 3
    docs = spark.createDataFrame([(None if i % 5 == 4 else i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, alignment.align(docs, A, B).collect()), key=repr)
    want = sorted(((None if i % 5 == 4 else i % 4, *w) for i, w in enumerate(brute(texts))), key=repr)
    assert got == want


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_pointers_reach_the_last_token_of_a_group():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 40))
        cut = lambda p: np.append(np.flatnonzero(rng.random(size - 1) < p) + 1, size)
        a, b = cut(rng.random()), cut(rng.random())
        la, lb = alignment.terminals(a, b)
        shared = np.intersect1d(a, b)
        assert np.array_equal(b[la], shared[np.searchsorted(shared, a)]) and np.array_equal(b[lb], shared[np.searchsorted(shared, b)])


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pairs_spelled_out_in_pieces(monkeypatch, size):
    rng = np.random.default_rng(5)
    group_a, group_b = np.sort(rng.integers(0, 9, 60)), np.sort(rng.integers(0, 9, 50))
    a, b = rng.integers(0, 7, 60), rng.integers(0, 5, 50)
    doc_of = np.array([0, 0, 0, 1, 1, 1, 2, 2, 2])
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", size)
    doc, pair, links = alignment._linked(a, b, group_a, group_b, doc_of, (7, 5))
    want = Counter((doc_of[g], x * 5 + y) for g, x in zip(group_a, a) for h, y in zip(group_b, b) if g == h)
    assert Counter(dict(zip(zip(doc.tolist(), pair.tolist()), links.tolist()))) == want
