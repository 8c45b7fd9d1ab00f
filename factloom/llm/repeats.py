"""Passages that an earlier place holds already: confirmed by counts of anchors, located by Aho-Corasick automata, removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ragged, staged, strings, words_of

#: Words of a window, and of the anchor inside it that stands for it.
WINDOW, ANCHOR = 20, 8
#: Bytes of text in a block, and words in an automaton (some 80 MB).
BLOCK_BYTES, AUTOMATON_WORDS = 4_000_000, 600_000
#: Bytes of text that a range of documents should have, and ranges at most; beyond, ranges grow, blocks don't.
RANGE_BYTES, RANGES_MOST = 16_000_000, 20_000

DOCS = "block long, place long, doc_id long, text string"


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order, with the number of their block and their place in the range."""
    base, size, place = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        before = np.cumsum(np.append(0, pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)))
        block = base + (size + before[:-1]) // BLOCK_BYTES
        yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(np.arange(place, place + batch.num_rows)), batch["doc_id"], batch["text"]], ["block", "place", "doc_id", "text"])
        size, place = size + int(before[-1]), place + batch.num_rows


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, place, doc_id, text), written: documents in order of doc_id, in blocks of about BLOCK_BYTES; a later document never has a smaller block.

    Documents of one id come in order of a hash of their text, those without id at the end.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(total // RANGE_BYTES, RANGES_MOST))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col("at")]
    ranged = plain.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return staged(ranged.select("doc_id", "text").mapInArrow(_blocked, DOCS), "blocks")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        return x ^ (x >> np.uint64(32))


def _grams(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of so many words from each place where they fit, by doubling."""
    n = len(word) - size + 1
    out, done, power, width = None, 0, word, 1
    while done < size:
        if size & width:
            out, done = (power[:n] if out is None else _mixed(out, power[done : done + n])), done + width
        power, width = (_mixed(power[:-width], power[width:]) if len(power) > width else power[:0]), 2 * width
    return out


class Windows:
    """All windows of some texts: where each starts, its hash, and the hash and place of its anchor.

    The anchor is the group of ANCHOR words in the window with the smallest hash, the leftmost of equal ones, so
    windows of the same words have the same anchor; neighbours often share one.
    """

    def __init__(self, text: pa.Array):
        self.words, self.cuts = words_of(text, lower=False)
        coded = self.words.dictionary_encode()
        self.index = coded.indices.to_numpy()
        self.size = len(coded.dictionary)
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in strings(coded.dictionary.cast(pa.large_binary()))], np.uint64)
        n = np.maximum(np.diff(self.cuts) - WINDOW + 1, 0)
        self.start = ragged(self.cuts[:-1], n)
        if not len(self.start):
            self.hash = self.anchor = np.zeros(0, np.uint64)
            self.at = self.start
            return
        word = hashed[self.index]
        self.hash = _grams(word, WINDOW)[self.start]
        best, at = _grams(word, ANCHOR), np.arange(len(word) - ANCHOR + 1)
        width, spread = WINDOW - ANCHOR + 1, 1
        while spread < width:  # the least of 1, 2, 4, ... neighbours, and of all in the window at last
            step = min(spread, width - spread)
            left, right = best[:-step], best[step:]
            later = right < left
            best, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
            spread += step
        self.anchor, self.at = best[self.start], at[self.start]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring windows with one anchor: the first of each run, its anchor, and a hash of all its windows."""
        first = np.flatnonzero(np.append(True, self.at[1:] != self.at[:-1])[: len(self.at)])
        last = np.append(first[1:], len(self.at))[: len(first)] - 1
        whole = _mixed(_mixed(self.hash[first], self.hash[last]), (last - first).astype(np.uint64))
        return first, self.anchor[first], whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, whole, block, n): distinct runs of each block in a batch."""
    for batch in batches:
        blocks = batch["block"].to_numpy()
        for block in np.unique(blocks).tolist():
            _, anchor, whole = Windows(batch["text"].filter(pa.array(blocks == block))).runs()
            table = pa.table({"anchor": _signed(anchor), "whole": _signed(whole), "n": pa.array(np.ones(len(anchor), np.int64))}).group_by(["anchor", "whole"]).aggregate([("n", "sum")])
            for part in table.append_column("block", pa.array(np.full(table.num_rows, block))).rename_columns(["anchor", "whole", "n", "block"]).select(["anchor", "whole", "block", "n"]).to_batches():
                yield part


def _windows(docs: pa.Table, anchors: pa.Table) -> pa.Table:
    """(anchor, window, block): the distinct windows of a block that have one of these anchors."""
    if not docs.num_rows or not anchors.num_rows:
        return pa.table({"anchor": pa.array([], pa.int64()), "window": pa.array([], pa.int64()), "block": pa.array([], pa.int64())})
    found = Windows(docs["text"].combine_chunks())
    wanted = np.isin(found.anchor, anchors["anchor"].to_numpy().view(np.uint64))
    table = pa.table({"anchor": _signed(found.anchor[wanted]), "window": _signed(found.hash[wanted])}).group_by(["anchor", "window"]).aggregate([])
    return table.append_column("block", pa.array(np.full(table.num_rows, docs["block"][0].as_py())))


def _spelled(found: Windows) -> str:
    """Each word as two characters, so that an automaton branches a few hundred ways at most; the two alphabets differ, so a phrase only fits where a word begins."""
    base = max(2, int(np.ceil(np.sqrt(found.size))))
    both = np.stack([256 + found.index // base, 256 + base + found.index % base], 1).ravel()
    return np.where(both >= 0xD800, both + 0x800, both).astype("<u4").tobytes().decode("utf-32-le")


def _located(found: Windows, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each word, which of these phrases (start and length in words, all different, none the beginning of another) occurs there, -1: none.

    The phrases are sharded over automata of AUTOMATON_WORDS words, and every text is streamed through each of them.
    """
    import ahocorasick

    spelled, out = _spelled(found), np.full(len(found.index), -1, np.int64)
    cuts = (2 * found.cuts).tolist()
    texts = [(a, spelled[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b - a >= 2 * WINDOW]
    shard = np.cumsum(length) // AUTOMATON_WORDS
    for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(shard)) + 1) if len(start) else []:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, a, n in zip(part.tolist(), (2 * start[part]).tolist(), (2 * length[part]).tolist()):
            automaton.add_word(spelled[a : a + n], i)
        automaton.make_automaton()
        for begin, text in texts:
            hits = list(automaton.iter(text))
            if hits:
                end, phrase = np.array(hits, np.int64).T
                out[(begin + end + 1) // 2 - length[phrase]] = phrase
    return out


def _phrases(found: Windows, seen: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, earlier) of a block's confirmed phrases, each once, at its first place here: those that an earlier block holds, or that recur here.

    Where an anchor has the same windows all over the block, and no earlier block holds only some of them, the run of
    its windows is one phrase; else each window is one.
    """
    whole = pc.is_null(seen["window"]).to_numpy()
    anchors, windows = seen["anchor"].to_numpy(), seen["window"].fill_null(0).to_numpy()
    first, anchor, runs = found.runs()
    anchor = anchor.view(np.int64)
    values, at, inverse, count = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
    single = np.ones(len(values), bool)
    single[inverse[runs != runs[at][inverse]]] = False
    single &= ~np.isin(values, anchors[~whole])
    before = np.isin(values, anchors[whole])
    n = np.diff(np.append(first, len(found.at)))
    taken = single & (before | (count > 1))
    run = at[taken]
    parts = [(found.start[first[run]], n[run] + WINDOW - 1, before[taken])]
    own = np.flatnonzero(~single[np.repeat(inverse, n)])
    if len(own):
        key, place, many = np.unique(found.hash[own].view(np.int64), return_index=True, return_counts=True)
        place = own[place]
        earlier = np.isin(found.anchor[place].view(np.int64), anchors[whole])
        asked = pa.table({"anchor": anchors[~whole], "window": windows[~whole]})
        there = pa.table({"anchor": _signed(found.anchor[place]), "window": pa.array(key), "i": np.arange(len(key))}).join(asked, ["anchor", "window"], join_type="inner")
        earlier[there["i"].to_numpy()] = True
        kept = earlier | (many > 1)
        parts.append((found.start[place[kept]], np.full(int(kept.sum()), WINDOW), earlier[kept]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _kept(docs: pa.Table, seen: pa.Table) -> pa.Table:
    """The block's texts without what an earlier place holds: seen has anchors all of whose windows occur in an earlier block (no window), and windows that do."""
    docs = docs.sort_by("place")
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])
    found = Windows(docs["text"].combine_chunks())
    edge = np.zeros(len(found.index) + 1, np.int64)
    if len(found.start):
        start, length, earlier = _phrases(found, seen)
        at = _located(found, start, length)
        place = np.flatnonzero(at >= 0)
        phrase = at[place]
        later = earlier[phrase] | (start[phrase] < place)
        np.add.at(edge, place[later], 1)
        np.add.at(edge, place[later] + length[phrase[later]], -1)
    return _result(docs["doc_id"].combine_chunks(), found, np.cumsum(edge)[:-1] > 0)


def _result(doc_id: pa.Array, found: Windows, gone: np.ndarray) -> pa.Table:
    n_words = np.diff(found.cuts)
    flips = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    inside = np.zeros(len(flips), bool)
    inside[found.cuts] = True  # a run ends with its text
    carried = inside[1:-1] & gone[:-1] & gone[1:] if len(gone) > 1 else np.zeros(0, bool)
    starts = np.union1d(np.flatnonzero(flips == 1), np.flatnonzero(carried) + 1)
    stops = np.union1d(np.flatnonzero(flips == -1), np.flatnonzero(carried) + 1)
    of = np.searchsorted(found.cuts, starts, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array((x - found.cuts[of]).astype(np.int32)) for x in (starts, stops)], ["start", "stop"])
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n_words)))]).astype(np.int32)
    removed = np.concatenate([[0], np.cumsum(gone)])[found.cuts]
    left = pa.ListArray.from_arrays(pa.array((found.cuts - removed).astype(np.int32)), found.words.filter(pa.array(~gone)).cast(pa.string()))
    kept = pc.binary_join(left, " ")
    return pa.table([doc_id, pa.array(n_words.astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), pa.ListArray.from_arrays(pa.array(per_doc), spans), kept], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def seen_before(blocks: DataFrame) -> DataFrame:
    """(block, anchor, window): what of a block's windows an earlier block holds; no window: all windows with that anchor.

    An anchor whose windows are alike wherever it occurs is decided by its first block; only for the others are the
    windows themselves compared. Anchors, and windows after them, meet as counts and least blocks alone, so no group of
    equal ones comes together in one task.
    """
    runs = staged(blocks.select("block", "text").mapInArrow(_anchors, "anchor long, whole long, block long, n long"), "anchors")
    known = runs.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("block").alias("first"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1").drop("n")
    own = staged(runs.select("anchor", "block").join(known, "anchor").where("mixed OR block > first").distinct(), "own-anchors")
    ask = own.where("mixed").select("block", "anchor")
    there = staged(blocks.select("block", "text").groupBy("block").cogroup(ask.groupBy("block")).applyInArrow(_windows, "anchor long, window long, block long"), "windows")
    first = there.groupBy("anchor", "window").agg(F.min("block").alias("first"))
    windows = there.join(first, ["anchor", "window"]).where("block > first").select("block", "anchor", "window")
    return staged(windows.union(own.where("NOT mixed").select("block", "anchor", F.lit(None).cast("long"))), "seen")


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, spans array<(start, stop)> of removed words, kept string), a row for each row of docs.

    Words are runs of [^\\x20\\x09-\\x0D]; a word goes if it lies in a window of WINDOW words of its document that also
    starts earlier: in a document of a smaller doc_id, or earlier in the same one. Kept words are joined by one blank.

    Documents are written once, in order, in blocks; Spark confirms which windows recur across blocks by their anchors
    (two 64-bit hashes together name a window), and each block compiles its confirmed phrases into Aho-Corasick automata
    that all its documents are streamed through. Documents of one doc_id are taken in order of a hash of their text,
    those without doc_id at the end; equal rows one after another. A null text is empty; texts of fewer than WINDOW
    words stay whole; other columns are left out; an empty table gives no rows.
    """
    blocks = in_blocks(docs)
    seen = seen_before(blocks)
    out = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, stop: int>>, kept string"
    return blocks.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(_kept, out)
