"""Two tokenizers over the same texts: token groups between shared byte offsets, and how often two ids meet."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_chars
from .common import bounded_batches, ragged, slices, staged, strings

#: Bytes of text that share a table of id pairs, pairs that are spelled out at a time, and code points up to which the quick encoder is used.
BLOCK_BYTES, PAIRS_AT_ONCE, LONG_TEXT = 3_000_000, 4_000_000, 1 << 18
#: Fixed value: how a byte-level pre-tokenizer splits a text, in the dialect of the quick encoder.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_made: dict[str, "Tokenizers"] = {}


class Tokenizers:
    """Both tokenizers in a worker, and the bytes that each id stands for."""

    def __init__(self, spec: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take all cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(spec)
        back = {c: b for b, c in enumerate(_byte_chars())}
        special = {t["content"] for t in parsed.get("added_tokens", [])}
        vocab = parsed["model"]["vocab"]
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.size_a = max(self.library.get_vocab().values()) + 1
        self.bytes_a = [b""] * self.size_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.quick = self._quick(parsed, ranks, vocab)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_b = [self._piece_bytes(i) for i in range(self.pieces.vocab_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _quick(parsed: dict, ranks: dict[bytes, int], vocab: dict[str, int]):
        """An encoder by ranks, where the file's merges are in order of the ids they make and its splitting is the plain byte-level one; else none."""
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in parsed["model"]["merges"]]
        before = parsed.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not parsed.get("normalizer")
        if not plain or merged != sorted(set(merged)) or parsed["model"].get("dropout") or parsed["model"].get("ignore_merges"):
            return None
        import tiktoken

        return tiktoken.Encoding("aligned", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        if self.quick and len(text) <= LONG_TEXT:
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text; none for an empty text, or one that either tokenizer does not give back byte for byte."""
        a = [self.encode_a(" " + t) if t else [] for t in texts]
        b = self.pieces.encode(texts, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for i, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(of_a, a[i])) != whole or b"".join(map(of_b, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


def _tokenizers(spec: str, pieces: bytes) -> Tokenizers:
    key = hashlib.sha256(spec.encode() + pieces).hexdigest()
    if key not in _made:
        _made[key] = Tokenizers(spec, pieces)
    return _made[key]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each token's group, as a place in b: for all tokens of a, and for all of b.

    end_a and end_b are the ascending byte offsets after each token of two divisions of the same bytes. A token points
    to its farthest-right overlapping token, the one that holds its last byte; a token of b that ends where one of a
    ends points to itself. Doubling the pointers until none moves takes the logarithm of the longest chain in rounds.
    """
    n = len(end_a)
    holds_a = np.searchsorted(end_b, end_a)  # the token of b with the last byte of each token of a
    holds_b = np.searchsorted(end_a, end_b)
    shared = end_a[holds_b] == end_b if n else np.zeros(0, bool)
    to = np.concatenate([n + holds_a, np.where(shared, n + np.arange(len(end_b)), holds_b)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n] - n, to[n:] - n
        to = further


def _counted(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (group, id), and how often each is there."""
    key, n = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, n


def _linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_of: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, pair of ids, links) of all groups; equal ids of a group are counted first, so a long run of them is one pair."""
    ga, ia, na = _counted(group_a, a, sizes[0])
    gb, ib, nb = _counted(group_b, b, sizes[1])
    first, upto = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    width = upto - first
    edges = np.concatenate([[0], np.cumsum(width)])
    base = int(sizes[0]) * int(sizes[1])
    keys, links = [], []
    at = 0
    while at < len(ga):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + PAIRS_AT_ONCE, "right")) - 1)
        left, right = np.repeat(np.arange(at, stop), width[at:stop]), ragged(first[at:stop], width[at:stop])
        key, where = np.unique(doc_of[ga[left]] * base + ia[left] * sizes[1] + ib[right], return_inverse=True)
        keys.append(key)
        links.append(np.bincount(where, na[left] * nb[right]).astype(np.int64))
        at = stop
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key // base, key % base, np.bincount(where, np.concatenate(links)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers with their lowest bytes first, then the next, and so on: small ones compress to little."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _texts_of_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each text: tokens in order, each with the mark that follows it."""
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    marks[place_a] = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]  # 0: comma, 1: bar, 2: semicolon, 3: nothing
    marks[place_b] = 2 * np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    cuts = cut_a + cut_b
    marks[cuts[1:][np.diff(cuts) > 0] - 1] = 3
    known, where = np.unique(ids * 4 + marks, return_inverse=True)
    spelled = [f"{x >> 2}{('', ',', '|', ';')[((x & 3) + 1) % 4]}" for x in known.tolist()]
    parts = np.array(spelled, object)[where].tolist() if len(known) else []
    return ["".join(parts[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


SCHEMA = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, doc_pairs binary, doc_links binary, pairs array<long>, docs array<int>"


def _aligned(batches: Iterator[pa.RecordBatch], spec: str, pieces: bytes) -> Iterator[pa.RecordBatch]:
    both = _tokenizers(spec, pieces)
    sizes = (both.size_a, len(both.bytes_b))
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays(_block(part, both, sizes, block), [f.split(" ")[0] for f in SCHEMA.split(", ")])
            block += 1


def _block(part: pa.RecordBatch, both: Tokenizers, sizes: tuple[int, int], block: int) -> list[pa.Array]:
    """The rows of SCHEMA for one block's texts; the first row carries the block's table of pairs and in how many of its texts each is."""
    n = part.num_rows
    per_a, per_b = both.both(strings(part["text"]))
    n_a, n_b = np.array([len(x) for x in per_a], np.int64), np.array([len(x) for x in per_b], np.int64)
    cut_a, cut_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    a = np.fromiter((i for x in per_a for i in x), np.int64, int(cut_a[-1]))
    b = np.fromiter((i for x in per_b for i in x), np.int64, int(cut_b[-1]))
    last_a, last_b = terminals(np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b]))
    ends, group_b = np.unique(last_b, return_inverse=True)
    group_a = np.searchsorted(ends, last_a)
    doc_of = np.searchsorted(cut_b, ends, "right") - 1
    doc, pair, links = _linked(a, b, group_a, group_b, doc_of, sizes)
    table, index, in_docs = np.unique(pair, return_inverse=True, return_counts=True)
    order = np.argsort(-in_docs, kind="stable")  # often met pairs get small numbers
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    index = rank[index]
    by_doc = np.lexsort((index, doc))
    doc, index, links = doc[by_doc], index[by_doc], links[by_doc]
    cuts = np.searchsorted(doc, np.arange(n + 1))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    groups = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in _texts_of_groups(a, b, group_a, group_b, cut_a, cut_b)]
    first = lambda x, kind: pa.array([x] + [None] * (n - 1), pa.list_(kind))
    return [
        pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), part["doc_id"], pa.array(n_a), pa.array(n_b), pa.array(np.bincount(doc_of, minlength=n)[:n].astype(np.int64)),
        pa.array(np.array([int(links[x:y].sum()) for x, y in spans], np.int64)), pa.array(groups, pa.string()),
        pa.array([_planes(np.diff(index[x:y], prepend=0)) for x, y in spans], pa.binary()), pa.array([_planes(links[x:y] - 1) for x, y in spans], pa.binary()),
        first(table[order], pa.int64()), first(in_docs[order].astype(np.int32), pa.int32()),
    ]


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's texts, from the counts of its pairs."""
    size = pairs.num_rows
    count, best = np.zeros(size, np.int64), np.zeros(size, bool)
    at = pairs["at"].to_numpy()
    count[at], best[at] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    sums, tops = [], []
    for index, links in zip(docs["doc_pairs"].to_pylist(), docs["doc_links"].to_pylist()):
        index, links = np.cumsum(_from_planes(index)), _from_planes(links) + 1
        sums.append(int((count[index] * links).sum()))
        tops.append(int(links[best[index]].sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(tops, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs["groups"])


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents two ids are linked, and whether no other id of b is linked with that id of a in more."""
    counts = blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    first_id: Column = F.expr(f"pair div {size_b}")
    top = counts.groupBy(first_id.alias("a")).agg(F.max("n").alias("top"))
    return counts.join(top, first_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, tokenizer_path: str, pieces_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs.

    a: a byte-level BPE file over a blank and the text; b: a sentencepiece file over the text, which adds the blank.
    Texts are tokenized where they are read, in blocks of some megabytes; each block keeps a table of its id pairs, and
    only these tables are counted, joined with the counts over all documents, and sent back to their blocks. Both files
    are read by the driver; their size bounds what is sent.

    Null and empty texts, and texts whose tokens do not add up to them, have no tokens: zeros and ''. Rows without
    doc_id and repeated rows each count as a document; other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f, open(pieces_path, "rb") as g:
        sent = spark.sparkContext.broadcast((f.read(), g.read()))
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_proto=sent.value[1]).vocab_size()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = staged(plain.mapInArrow(lambda batches: _aligned(batches, *sent.value), SCHEMA), "aligned")
    own = blocks.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("at", "pair"))
    found = staged(own.join(pair_counts(blocks, size_b), "pair").select("block", "at", "n", "best"), "pair-counts")
    rows = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "doc_pairs", "doc_links")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scored, out)
