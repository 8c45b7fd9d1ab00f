"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, texts, words_of

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, radius of the candidate search, and blocks: of two fingerprints within the radius, some block
#: differs in a BLOCKS-th of it at most. Windows of similarity 0.8 differ in 39 bits on average, by 6 more or less, so
#: about one in 100,000 of those lies beyond the radius; of random windows 0.8 % have a block within 7 of 32 bits.
BITS, RADIUS, BLOCKS = 256, 63, 8
#: Items that are sent to the tasks at once; a larger benchmark is searched in several passes over the documents.
ITEMS_PER_PASS = 20_000

_P = np.uint64(0x9E3779B97F4A7C15)
#: Windows whose fingerprints are made together.
_WINDOWS = 4096


def _word_hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in strings(coded.dictionary)], np.uint64)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _P + hashes[i : i + n]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(shingles: np.ndarray) -> np.ndarray:
    """BITS bits of each shingle's hash, from as many further hashes as they need."""
    words = np.stack([_mixed(shingles + step) for step in np.arange(BITS // 64, dtype=np.uint64) * _P], axis=1)
    return np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)


def window_prints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints, as BLOCKS numbers each, of the windows of n shingles from starts; each occurrence weighs one."""
    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(shingles), axis=0, dtype=np.int32)])
    return np.packbits(2 * (sums[starts + n] - sums[starts]) > n, axis=1).view(np.uint32)


class Items:
    """Items by their number of words, with the index of their fingerprints' blocks."""

    def __init__(self, rows: list[tuple[int, str]]):
        words, at = words_of(pa.array([t or "" for _, t in rows], pa.string()))
        hashes = _word_hashes(words)
        self.ids = [i for i, _ in rows]
        self.sizes = np.diff(at)
        self.shingles = [_shingles(hashes[s:e], min(SHINGLE_WORDS, max(e - s, 1))) for s, e in zip(at[:-1], at[1:])]
        self.prints = np.array([window_prints(s, np.array([0]), len(s))[0] if len(s) else np.zeros(BLOCKS, np.uint32) for s in self.shingles], np.uint32).reshape(-1, BLOCKS)
        self.of: dict[int, set[int]] = defaultdict(set)
        for i, s in enumerate(self.shingles):
            for x in s.tolist():
                self.of[x].add(i)
        self.all = np.array(sorted(self.of), np.uint64)
        self.short = sorted({int(n) for n in self.sizes if 0 < n < SHINGLE_WORDS})

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The index of the items of so many words: these items, and for each byte of a fingerprint and each value of it the set of those, as bits, that differ from it in one bit at most."""
        tables = self.__dict__.setdefault("tables", {})  # made in the worker where they are first needed
        if size not in tables:
            own = np.flatnonzero(self.sizes == size)
            prints = np.ascontiguousarray(self.prints[own]).view(np.uint8)
            near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= 1
            tables[size] = own, np.stack([np.packbits(near[:, prints[:, p]], axis=1) for p in range(prints.shape[1])])
        return tables[size]

    def candidates(self, window: np.ndarray, items: np.ndarray) -> np.ndarray:
        """(window number, position in items) of all pairs whose fingerprints are within RADIUS; items are ascending and of one size.

        Of two fingerprints within RADIUS some block differs in RADIUS // BLOCKS bits at most, and some byte of that
        block in a quarter of those, one. So the windows' bytes are looked up in the items' tables, and only what is
        found there is compared, block by block and then as a whole.
        """
        own, table = self.table(int(self.sizes[items[0]]))
        values = np.ascontiguousarray(window).view(np.uint8)
        met = np.zeros((len(window), table.shape[2]), np.uint8)
        for p in range(len(table)):
            met |= table[p][values[:, p]]
        met &= np.packbits(np.isin(own, items))
        w, i = np.nonzero(np.unpackbits(met, axis=1, count=len(own)))
        i = np.searchsorted(items, own[i])
        apart = np.bitwise_count(window[w] ^ self.prints[items[i]])
        close = (apart <= RADIUS // BLOCKS).any(axis=1) & (apart.sum(axis=1, dtype=np.int64) <= RADIUS)
        return np.stack([w[close], i[close]])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over joint shingles, each as often as it occurs."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(n[i], m[j]).sum()
    return float(shared / (len(a) + len(b) - shared)) if len(a) + len(b) else 0.0


def search(hashes: np.ndarray, items: Items, found: dict[int, np.ndarray]) -> Iterator[tuple[int, int, float]]:
    """(item, first best start in words, similarity) for one document; found: places of shingles of items, by shingle length."""
    places: dict[int, list[int]] = defaultdict(list)
    for k, at in found.items():
        for p, x in zip(at.tolist(), _shingles(hashes, k)[at].tolist() if len(at) * 8 > len(hashes) else [int(_shingles(hashes[p : p + k], k)[0]) for p in at.tolist()]):
            for i in items.of[x]:
                if min(items.sizes[i], SHINGLE_WORDS) == k:
                    places[i].append(p)
    by_size: dict[int, list[int]] = defaultdict(list)
    for i, at in places.items():
        if len(at) >= SIMILARITY * len(items.shingles[i]):  # fewer can't reach the similarity in any window
            by_size[int(items.sizes[i])].append(i)
    for size, group in by_size.items():
        k, size = min(size, SHINGLE_WORDS), min(size, len(hashes))
        n = size - k + 1
        low, high = min(min(places[i]) for i in group), max(max(places[i]) for i in group)
        low, high = max(0, low - n + 1), min(high, len(hashes) - size)
        near = np.unique(np.concatenate([np.add.outer(np.array(places[i]), np.arange(1 - n, 1)).ravel() for i in group]))
        starts = near[(near >= low) & (near <= high)]
        if not len(starts):
            continue
        group, best = np.array(sorted(group)), {}
        ends = np.flatnonzero((np.diff(starts) > n) | (np.arange(1, len(starts)) % _WINDOWS == 0)) + 1
        for part in np.split(starts, ends):
            first = int(part[0])
            shingles = _shingles(hashes[first : int(part[-1]) + size], k)
            for w, i in items.candidates(window_prints(shingles, part - first, n), group).T.tolist():
                s = int(part[w])
                value = similarity(shingles[s - first : s - first + n], items.shingles[group[i]])
                if value >= SIMILARITY and value > best.get(i, (0.0, 0))[0]:
                    best[i] = (value, s)
        for i, (value, s) in sorted(best.items()):
            yield items.ids[group[i]], s, value


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): each document and item of which some window is similar, its first best window.

    A window has as many words as the item (a shorter document is one window); words are split at ASCII white space, A-Z
    in lower case; similarity, 0.8 or more, is of shingles of five words, each as often as it occurs. Windows around
    places that share too few shingles with an item to reach it get no fingerprint, which loses none. Items without words match nothing,
    items of fewer than five words match as a whole; null texts are empty; repeated rows and items are found alike; rows
    without doc_id are found with a null doc_id. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    passes = -(-asked.count() // ITEMS_PER_PASS)
    out = spark.createDataFrame([], "doc_id long, item_id long, start_word long, similarity double")
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        out = out.union(_one_pass(docs, [(r.item_id, r.text) for r in rows]))
    return out


def _one_pass(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Items(rows))
    names = ["doc_id", "item_id", "start_word", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        seen = np.zeros(1 << 22, bool)
        seen[(items.all >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            words, at = words_of(batch["text"])
            hashes = _word_hashes(words)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            found: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
            for k in [*items.short, SHINGLE_WORDS]:
                s = _shingles(hashes, k)
                maybe = np.flatnonzero(seen[(s >> np.uint64(42)).astype(np.int64)])
                maybe = maybe[doc[maybe] == doc[maybe + k - 1]]
                there = np.minimum(np.searchsorted(items.all, s[maybe]), max(len(items.all) - 1, 0))
                maybe = maybe[items.all[there] == s[maybe]] if len(items.all) else maybe[:0]
                cuts = np.flatnonzero(np.diff(doc[maybe])) + 1
                for part in np.split(maybe, cuts):
                    if len(part):
                        found[int(doc[part[0]])][k] = part - at[doc[part[0]]]
            result = [(d, *hit) for d, by in sorted(found.items()) for hit in search(hashes[at[d] : at[d + 1]], items, by)]
            if result:
                d, i, s, v = zip(*result)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(d)), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(v, pa.float64())], names)

    return texts(docs).mapInArrow(run, "doc_id long, item_id long, start_word long, similarity double")
