"""Token ids as canonical, length-limited Huffman codes: writing, and table-driven reading in independent blocks."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, new_path, ragged, slices, strings, texts

#: Longest code in bits, ids between two checkpoints, and ids from which a block is closed.
MAX_BITS, STRIDE, BLOCK_IDS = 16, 256, 1 << 17
#: Words that a worker remembers the ids of at most, some 60 bytes each.
CACHE_WORDS = 600_000

_cache: dict[str, "WordIds | WholeIds"] = {}

#: How the tokenizer that WordIds is right for prepares a text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ],
}


def _plain_words(spec: str) -> bool:
    """Whether a tokenizer file drops white space, lowers letters and ends words as WordIds expects; keys beyond the fixed ones don't matter."""
    parsed = json.loads(spec)
    part = lambda found, want: all(part(found.get(k), v) if isinstance(v, dict) else (len(found.get(k) or ()) == len(v) and all(map(part, found[k], v))) if isinstance(v, list) else found.get(k) == v for k, v in want.items()) if isinstance(found, dict) else False
    return part(parsed.get("normalizer"), NORMALIZER) and part(parsed.get("pre_tokenizer"), PRE_TOKENIZER) and parsed["model"].get("end_of_word_suffix") == "</w>"


def encoder(spec: str) -> "WordIds | WholeIds":
    """The worker's encoder of this tokenizer file; another file gets another one."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _cache:
        _cache.clear()  # one vocabulary and its remembered words at a time
        _cache[key] = (WordIds if _plain_words(spec) else WholeIds)(spec)
    return _cache[key]


class WholeIds:
    """Ids of texts by the tokenizers library, each text as a whole: right for any tokenizer file."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(strings(text), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)


class WordIds:
    """Ids of texts by the tokenizers library, each distinct piece between white space encoded once and remembered.

    White space always splits words in this tokenizer and leaves no ids, and so does the place between a letter and
    ASCII punctuation; ids of a text are those of its pieces in order. A piece with a special token's bars is left whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.starts, self.counts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Encode pieces that are not remembered yet: letters alone, which make one word each, many to a text."""
        letters = np.array([p.isalpha() and p.islower() and max(p) <= "\u017f" for p in new], bool)
        names = [new[i] for i in np.flatnonzero(letters).tolist()]
        found = self.tokenizer.encode_batch_fast([" ".join(names[i : i + 500]) for i in range(0, len(names), 500)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *[np.array(e.ids, np.int32) for e in found]])
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(names):  # a vocabulary that marks no ends of words: one by one
            letters[:] = False
            ids, ends = ids[:0], ends[:0]
        plain, other = np.flatnonzero(letters), np.flatnonzero(~letters)
        counts, parts = np.zeros(len(new), np.int32), [ids]
        counts[plain] = np.diff(np.concatenate([[-1], ends]))
        for i in range(0, len(other), 2000):
            some = other[i : i + 2000]
            e = self.tokenizer.encode([new[k] for k in some.tolist()], is_pretokenized=True, add_special_tokens=False)
            counts[some] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            parts.append(np.array(e.ids, np.int32))
        starts, order, base = np.zeros(len(new), np.int32), np.concatenate([plain, other]), len(self.ids)
        starts[order] = base + np.cumsum(counts[order]) - counts[order]
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, *parts])

    def of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        text = text.cast(pa.large_string())
        plain = pc.replace_substring_regex(text, r"([A-Za-z])([,.%$#&*!?:;]+)", r"\1 \2")
        barred = pc.match_substring(text, "<|")
        text = pc.if_else(barred, text, pc.ascii_lower(plain)) if pc.any(barred).as_py() else pc.ascii_lower(plain)
        split = pc.ascii_split_whitespace(text)
        coded = pc.list_flatten(split).dictionary_encode()
        if len(self.words) > CACHE_WORDS:
            self.clear()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        new, word = known.is_null().to_numpy(zero_copy_only=False), known.fill_null(0).to_numpy().copy()
        if new.any():
            word[new] = np.arange(len(self.words), len(self.words) + new.sum())
            pieces = coded.dictionary.filter(pa.array(new))
            self._learn(strings(pieces))
            self.words = pa.concat_arrays([self.words, pieces])
        word = word[coded.indices.to_numpy()]
        lengths = self.counts[word].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        return self.ids[ragged(self.starts[word], lengths)], np.diff(cuts)


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Bits of each id's code: the best with no code over limit (package-merge)."""
    items = sorted((n, i) for i, n in counts.items() if n > 0)
    if len(items) <= 1:
        return {i: 1 for _, i in items}
    if len(items) > 1 << limit:
        raise ValueError(f"{len(items)} ids need codes of more than {limit} bits")
    weight = np.array([n for n, _ in items], np.int64)
    # each level holds the sorted leaves and the pairs of the level below; what the first 2n - 2 of the top use, counts
    levels, pairs = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        both = both[order]
        pairs = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    bits, take = np.zeros(len(items), np.int64), 2 * len(items) - 2
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    return {i: int(b) for (_, i), b in zip(items, bits)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """By id: code and bits. Codes ascend by (bits, id)."""
    size = max(lengths, default=-1) + 1
    codes, bits = np.zeros(size, np.uint32), np.zeros(size, np.int64)
    code = last = 0
    for b, i in sorted((b, i) for i, b in lengths.items()):
        code <<= b - last
        codes[i], bits[i], last = code, b, b
        code += 1
    return codes, bits


def pack(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids, first bit highest, and the bit offset of each STRIDE-th id."""
    n = bits[ids]
    ends = np.cumsum(n)
    at = ends - n
    size = int(ends[-1] + 7) // 8 if len(ids) else 0
    value = codes[ids].astype(np.uint32) << (24 - n - (at & 7)).astype(np.uint32)
    first, out = at >> 3, np.zeros(size + 3)
    for k in range(3):  # bits of different ids never overlap, so sums are unions
        out += np.bincount(first + k, weights=(value >> np.uint32(16 - 8 * k)) & np.uint32(255), minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes(), at[::STRIDE].copy()


class Decoder:
    """Looks up MAX_BITS bits at a time; all checkpoints of a block advance side by side."""

    def __init__(self, lengths: dict[int, int]):
        codes, bits = canonical(lengths)
        self.table = np.zeros(1 << MAX_BITS, np.int32)  # an id and, in the low five bits, its code's length
        for i in lengths:
            low = int(codes[i]) << (MAX_BITS - int(bits[i]))
            high = low + (1 << (MAX_BITS - int(bits[i])))
            self.table[low:high] = i << 5 | int(bits[i])

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8)]).astype(np.int32)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at, out = checkpoints.astype(np.int32), np.zeros((STRIDE, len(checkpoints)), np.int32)
        last = 8 * len(payload)
        for k in range(min(STRIDE, n)):
            found = self.table[(window[at >> 3] >> (8 - (at & 7))) & 65535]
            out[k] = found
            at += found & 31
            np.minimum(at, last, out=at)
        return (out >> 5).T.reshape(-1)[:n]


TOKENS = "doc_id long, ids binary"
BLOCK = "part int, first long, n_ids long, doc_ids array<long>, counts array<long>, checkpoints array<long>, payload binary"
#: Bytes of text that are tokenized together.
SLICE_BYTES = 3_000_000


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of ids one after the other, and each row's number of them."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    ids = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view(kind) if raw is not None else np.zeros(0, kind)
    return ids, np.diff(at) // np.dtype(kind).itemsize


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> None:
    """Tokenize docs and write their ids, end_id after each, in ascending doc_id order (nulls first; ties by their ids).

    path/blocks holds a row for each block: its part, the ids before it in the part, its documents and their numbers
    of ids, the bit offset of each 256th id, and the packed codes. path/codes holds the code lengths: codes follow from
    them. A document never spans two blocks. Texts that are null or empty have the end id alone; an empty table
    writes no block. Codes come from the counts of all ids, collected as at most one row for each id of the vocabulary;
    more than 65,536 different ids have no codes of 16 bits and raise ValueError. Texts are tokenized where they are
    read: what is put in order is their ids, of 16 bits each where the vocabulary allows it.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    wide = max([*json.loads(spec)["model"]["vocab"].values(), end_id]) > 65535
    kind = "<u4" if wide else "<u2"
    sent = spark.sparkContext.broadcast(spec)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(sent.value)
        for batch in batches:
            for rows in slices(batch, SLICE_BYTES):
                ids, n = words.of(rows["text"])
                ids = np.insert(ids, np.cumsum(n), end_id).astype(kind)
                cuts = np.concatenate([[0], np.cumsum(n + 1)]) * ids.itemsize
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows["doc_id"], binary.cast(pa.binary())], ["doc_id", "ids"])

    tokens_path = new_path(spark, "tokens")
    texts(docs).mapInArrow(tokenize, TOKENS).write.parquet(tokens_path)
    tokens = spark.read.schema(TOKENS).parquet(tokens_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            now = np.bincount(_flat(batch["ids"], kind)[0], minlength=len(total))
            now[: len(total)] += total
            total = now
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lengths = code_lengths({r.id: r.n for r in counts.collect()})
    table = spark.sparkContext.broadcast(canonical(lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        doc_ids, counts, held, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload, marks = pack(ids, *table.value)
            row = [part, first, len(ids), doc_ids, counts, marks.tolist(), payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int64(), pa.int64(), longs, longs, longs, pa.binary()]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            ids, n = _flat(batch["ids"], kind)
            docs_here, cuts, at = batch["doc_id"].to_pylist(), np.concatenate([[0], np.cumsum(n)]), 0
            while at < len(n):
                upto = min(len(n), int(np.searchsorted(cuts[1:], cuts[at] + BLOCK_IDS - size)) + 1)
                doc_ids += docs_here[at:upto]
                counts += n[at:upto].tolist()
                held.append(ids[cuts[at] : cuts[upto]])
                size += int(cuts[upto] - cuts[at])
                at = upto
                if size >= BLOCK_IDS:
                    yield block()
                    first, doc_ids, counts, held, size = first + size, [], [], [], 0
        if size:
            yield block()

    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    ordered.select("doc_id", "ids").mapInArrow(encode, BLOCK).write.parquet(f"{path}/blocks")
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    delete_path(spark, tokens_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of a written file: start counts the ids of all documents before, ids are little-endian unsigned 32-bit."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    lengths = spark.sparkContext.broadcast({r.id: r.bits for r in spark.read.parquet(f"{path}/codes").collect()})
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each range of doc_ids
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths.value)
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch[name][row]  # noqa: E731, B023
                ids = decoder.unpack(value("payload").as_py(), value("checkpoints").values.to_numpy(), value("n_ids").as_py()).astype("<u4")
                n = value("counts").values.to_numpy()
                cuts = np.concatenate([[0], np.cumsum(n)])
                starts = before[value("part").as_py()] + value("first").as_py() + cuts[:-1]
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([value("doc_ids").values, pa.array(starts), pa.array(n), binary], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
