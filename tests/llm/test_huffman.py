"""Huffman files: exact round trips, best lengths under the limit, ids of the tokenizers library."""

import heapq
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from factloom.llm import huffman, queries
from factloom.llm.common import new_path

PATH = P.path("word_bpe_49k.json")


def plain_cost(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def test_code_lengths():
    rng = random.Random(2)
    counts = {i: rng.randint(1, 500) for i in range(300)}
    lengths = huffman.code_lengths(counts)
    assert sum(2.0 ** -b for b in lengths.values()) == 1
    assert sum(counts[i] * b for i, b in lengths.items()) == plain_cost(counts.values())
    steep = {i: 1 << min(i, 50) for i in range(40)}
    limited = huffman.code_lengths(steep, 8)
    assert max(limited.values()) == 8 and sum(2.0 ** -b for b in limited.values()) <= 1
    assert huffman.code_lengths({}) == {} and huffman.code_lengths({9: 4}) == {9: 1}


def test_pack_and_unpack():
    rng = np.random.default_rng(4)
    for n in (1, 255, 256, 257, 5000):
        ids = np.minimum(rng.geometric(0.02, n), 900).astype(np.int32)
        lengths = huffman.code_lengths(dict(zip(*[x.tolist() for x in np.unique(ids, return_counts=True)])))
        payload, marks = huffman.pack(ids, *huffman.canonical(lengths))
        assert (huffman.Decoder(lengths).unpack(payload, marks, n) == ids).all()


def test_round_trip_of_odd_texts(spark):
    texts = ["", None, "Hello, World!", "it's  WE'LL's", "x<|endoftext|>Y <|startoftext|>", "<|EndOfText|>", "É́cole ΣΑΣ İstanbul", "日本 語　x", "a,b.c%%%d!!'s", "1234 ½", "w " * 9000, "q" * 5000, "\x1c\x85  z", "a,'s .'t"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "no id"), (50, "twice"), (50, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as part", "'s' as ids")
    path = new_path(spark, "test")
    huffman.write(docs, PATH, path)
    got = sorted(huffman.read(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    start = 0
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0])), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(want)), text
        assert np.frombuffer(r.ids, "<u4").tolist() == want, text
        start += len(want)


def test_empty_table(spark):
    path = new_path(spark, "test")
    huffman.write(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert huffman.read(spark, path).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in sorted(queries.op1_huffman_ids(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = np.array(library.encode(texts.pop(r.doc_id), add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not texts


def test_two_tokenizers_in_one_session(spark, tmp_path):
    texts = ["Hello WORLD, it's me", "a <|endoftext|> b", "  tabs\tand\nlines  ", "日本 ñ", "", "MIXED Case tokens 123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for n, name in enumerate(("word_bpe_49k.json", "byte_bpe_50k.json", "word_bpe_49k.json")):
        huffman.write(docs, P.path(name), f"{tmp_path}/{n}")
        library = Tokenizer.from_file(P.path(name))
        library.no_truncation()
        library.no_padding()
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in huffman.read(spark, f"{tmp_path}/{n}").collect()}
        assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}, name


def test_the_short_way_is_for_one_kind_of_file_only():
    word, byte = (open(P.path(n), encoding="utf-8").read() for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert isinstance(huffman.encoder(word), huffman.WordIds) and isinstance(huffman.encoder(byte), huffman.WholeIds)
    other = json.loads(word)
    other["normalizer"]["normalizers"].pop()
    assert isinstance(huffman.encoder(json.dumps(other)), huffman.WholeIds)
