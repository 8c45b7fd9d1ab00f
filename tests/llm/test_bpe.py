"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from factloom.llm import bpe, queries

PATH = P.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  \n\n ", "a", "it's we'll I'D", "aaaa aaaaaaaa aaaaaaaaaaaaaaaaa", "hello  world   \n  again\t\tx ", "日本語 テキスト ñandú Ünïcode", "😀😀 😀é é", "x<|endoftext|>y", " <|endoftext|> ",
    "<|endoftext|><|endoftext|>", "12345 67 8,9.0", "!!!??? ... ---===", "   nbsp\u0085next", "tab\tend ", "\r\n\r\nx", "word " * 3000, "z" * 20000, "\x00\x01 a\x1cb", "٣٤ ½ Ⅷ", "a​b   c",
]


def test_encode_and_decode_match_library(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab cdeéß\n's1 ,.#日") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts = ODD + made + made[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "3 as words", "'q' as ids")
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, repr(t)
        assert got[i].n_tokens == len(want)
        assert got[i].text == library.decode(want, skip_special_tokens=False), repr(t)


def test_whole_table_matches_library(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    rows = queries.op5_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []


def test_bytes_that_are_not_text(spark):
    lone = spark.createDataFrame([(1, 1, bytearray(np.array([172], "<u4").tobytes())), (2, 0, None)], "doc_id long, n_tokens long, ids binary")
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.text for r in bpe.decode(lone, PATH).collect()}
    assert got == {1: library.decode([172], skip_special_tokens=False), 2: ""}


def test_round_trip_is_decoded_encoding(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld <|endoftext|> 日本"), (None, None), (2, ""), (2, "x" * 9000)], "doc_id long, text string")
    both = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(map(repr, bpe.round_trip(docs, PATH).collect())) == sorted(map(repr, both.collect()))
