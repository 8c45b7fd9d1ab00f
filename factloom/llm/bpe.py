"""Byte-level BPE encoding with a pair occurrence index, and decoding."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ragged, strings, texts

#: How the tokenizer file's byte-level pre-tokenizer splits a text, in Java's regex dialect.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)
#: Bytes of text whose distinct words are encoded together.
BLOCK_BYTES = 4 << 20


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [other.get(b, chr(b)) for b in range(256)]


class Vocabulary:
    """Merges and byte strings of a byte-level BPE file; its size bounds what is sent to the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = _byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.size = max([*ids.values(), *special.values()]) + 1
        self.byte_ids = np.array([ids[c] for c in chars], np.int32)
        self.special = {k.encode(): v for k, v in special.items()}
        self.token_bytes = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if token not in special else token.encode()
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        pairs = self.left * self.size + self.right
        self.rank_order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.rank_order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for a pair that never merges."""
        pair = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank_order[at], -1)


def encode_words(data: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (bytes one after the other, and each word's length > 0), and how many each word has.

    An index maps each pair of neighbouring symbols to all its positions in all words; pairs are taken in ascending
    rank, all positions of a pair are merged at once, and the pairs that this makes join the index.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
    ends = np.cumsum(lengths)
    symbol = vocab.byte_ids[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        at = at[after[at] >= 0]
        rank = vocab.ranks(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(part)

    add(np.arange(n))
    while active:
        rank = heapq.heappop(active)
        found = index.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        left, right = vocab.left[rank], vocab.right[rank]
        at = at[(symbol[at] == left) & (after[at] >= 0)]
        at = at[symbol[after[at]] == right]
        if not len(at):
            continue
        if left == right and len(at) > 1:  # of a run of equal symbols, each second position, from the left
            at = np.sort(at)
            opens = np.concatenate([[True], after[at[:-1]] != at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
        gone = after[at]
        symbol[at], symbol[gone] = vocab.made[rank], -1
        rest = after[gone]
        after[at] = rest
        some = rest >= 0
        before[rest[some]] = at[some]
        prior = before[at]
        add(np.unique(np.concatenate([at, prior[prior >= 0]])))
    live = symbol >= 0
    return symbol[live], np.add.reduceat(live, ends - lengths).astype(np.int64)


def pre_tokens(text: Column, specials: list[str]) -> Column:
    """The pre-tokenizer's words; a special token's string is a word of its own."""
    split = F.lit(SPLIT)
    words = F.regexp_extract_all(text, split, 0)
    for token in specials:
        quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in token)
        parts = F.transform(F.split(text, quoted, -1), lambda p: F.concat(F.array(F.lit(token)), F.regexp_extract_all(p, split, 0)))
        words = F.when(text.contains(token), F.slice(F.flatten(parts), 2, 2147483647)).otherwise(words)
    return words


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * BLOCK_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += batch.nbytes * min(step, batch.num_rows - at) // batch.num_rows
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, vocab: Vocabulary) -> Batches:
    """doc_id, n_tokens and ids of batches of doc_id and pre-tokens."""
    for block in _blocks(batches):
        parts = [pc.list_flatten(b["words"]).cast(pa.large_binary()) for b in block]
        coded = pa.concat_arrays(parts).dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        special = {i: vocab.special[w] for i, w in enumerate(strings(distinct)) if w in vocab.special} if pc.any(pc.is_in(distinct, pa.array(list(vocab.special), pa.large_binary()))).as_py() else {}
        data = np.frombuffer(b"".join(strings(distinct)), np.uint8)
        ids, counts = encode_words(data, pc.binary_length(distinct).to_numpy(), vocab)
        starts = np.cumsum(counts) - counts
        for i, token in special.items():
            starts[i], counts[i] = len(ids), 1
            ids = np.append(ids, np.int32(token))
        at = np.cumsum([0, *map(len, parts)])
        for batch, low, high in zip(block, at[:-1], at[1:]):
            word = index[low:high]
            n_words = pc.list_value_length(batch["words"]).to_numpy()
            lengths = counts[word]
            total = np.concatenate([[0], np.cumsum(lengths)])
            cuts = total[np.concatenate([[0], np.cumsum(n_words)])]
            out = ids[ragged(starts[word], lengths)].astype("<u4")
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((cuts * 4).astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(cuts)), binary.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])


def _decoded(batches: Batches, token_bytes: list[bytes]) -> Batches:
    """The batches with the text of their ids."""
    token = token_bytes.__getitem__
    for batch in batches:
        found = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in strings(batch["ids"])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["doc_id", "n_tokens", "ids", "text"])


ENCODED = "doc_id long, n_tokens long, ids binary"


def _words(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    return texts(docs).select("doc_id", pre_tokens(F.col("text"), [k.decode() for k in vocab.special]).alias("words"))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers, a row for each row of docs.

    Special tokens in a text become their ids, nothing is added, nothing is cut. A null or empty text has no ids;
    repeated rows stay; rows without doc_id are encoded too; an empty table gives no rows. The file is read by the driver.
    """
    vocab = Vocabulary(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    return _words(docs, vocab).mapInArrow(lambda batches: _encoded(batches, sent.value), ENCODED)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) for encode()'s rows: special tokens stay, invalid UTF-8 becomes U+FFFD, null ids an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path).token_bytes)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(lambda batches: _decoded(batches, sent.value), f"{ENCODED}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """decode(encode(docs)): both in one Python worker for each task, which needs half the memory of two in a row."""
    vocab = Vocabulary(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    return _words(docs, vocab).mapInArrow(lambda batches: _decoded(_encoded(batches, sent.value), sent.value.token_bytes), f"{ENCODED}, text string")
