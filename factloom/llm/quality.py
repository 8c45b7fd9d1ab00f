"""Quality rules: text counts, and n-gram perplexity bands of a modified Kneser-Ney model for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, code_points, slices, staged, strings, words_of

#: An n-gram is ORDER code points of 16 bits each in one 64-bit key; EDGE stands before a text. Code points beyond 16 bits share the private-use ones.
ORDER, BITS, EDGE = 4, 16, 0xFFFF
#: Rules: fewest words, most repeated words in percent, and how many quartile ranges a band reaches below and above the median.
LEAST_WORDS, MOST_REPEATED, BELOW, ABOVE = 10, 20, 5.0, 8.0
#: A text of so many characters varies twice as much (in variance) as a very long one; its band is wider.
SHORT_CHARS = 400
#: What the model and the bands learn from: texts that pass the rules, with at most so many marks and capitals in percent of their characters.
MOST_MARKS, MOST_CAPITALS = 1, 10
#: Characters that are counted into n-grams before they are handed on, and n-grams sent to the tasks at once.
FLUSH, MODEL_ROWS = 4_000_000, 1 << 22
_MARKS = "#*$%&|<>"
_UPPER = np.array([chr(c).isupper() for c in range(0x3000)] + [False])


def grams(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each character, it and the ORDER - 1 before it in its text, as one 64-bit key."""
    own = np.where(points < 1 << BITS, points, 0xE000 + points % 0x1900).astype(np.uint64)
    place = np.arange(len(points)) - np.repeat(cuts[:-1], np.diff(cuts))
    out = own.copy()
    for k in range(1, ORDER):
        prior = np.full(len(points), EDGE, np.uint64)
        prior[k:] = own[:-k] if len(points) > k else prior[k:]
        prior[place < k] = EDGE
        out |= prior << np.uint64(BITS * k)
    return out.view(np.int64)


class Measured:
    """The counts of each text of a batch, and its code points."""

    def __init__(self, text: pa.Array):
        words, at = words_of(text, lower=False)
        self.points, self.cuts = code_points(text)
        spaces = (self.points == 32) | ((self.points >= 9) & (self.points <= 13))
        marks = np.isin(self.points, [ord(c) for c in _MARKS])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[self.cuts])
        self.n_words, self.n_chars = np.diff(at), np.diff(self.cuts)
        self.word_chars, self.n_symbols = self.n_chars - total(spaces), total(marks)
        self.n_repeat_words = _repeated(words, at)
        passed = (self.n_words >= LEAST_WORDS) & (100 * self.n_repeat_words <= MOST_REPEATED * self.n_words)
        capitals = total(_UPPER[np.minimum(self.points, len(_UPPER) - 1)])
        self.plain = passed & (100 * self.n_symbols <= MOST_MARKS * self.n_chars) & (100 * capitals <= MOST_CAPITALS * self.n_chars)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, gram long, n long, own long) over all rows (lang, text): how often in all texts and in those to learn from, counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, plain in sorted(held):
                keys, n = np.unique(np.concatenate(held[lang, plain]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n), pa.array(n * plain)], ["lang", "gram", "n", "own"])
            held.clear()

        for whole in batches:
            for batch in slices(whole):
                langs = np.array(strings(batch["lang"]), object)
                m = Measured(batch["text"])
                keys, row = grams(m.points, m.cuts), np.repeat(np.arange(batch.num_rows), m.n_chars)
                for lang in sorted(set(langs)):
                    for plain in (False, True):
                        some = keys[((langs == lang) & (m.plain == plain))[row]]
                        if len(some):
                            held.setdefault((lang, plain), []).append(some)
                size += len(keys)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, gram long, n long, own long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def discounts(n: dict[int, int]) -> list[float]:
    """What is taken off a count of 1, 2, 3 and more, by how many n-grams have counts of 1 to 4."""
    c = [n.get(k, 0) for k in range(1, 5)]
    if not all(c[:3]):
        return [0.5, 0.75, 1.0]
    y = c[0] / (c[0] + 2 * c[1])
    raw = (1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2])
    return [min(max(x, 0.01), top) for x, top in zip(raw, (1.0, 1.99, 2.99))]


def _last(key: Column, k: int) -> Column:
    """The last k characters of a key."""
    return key if k == ORDER else key.bitwiseAND(F.lit((1 << BITS * k) - 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp) for each row of counts (lang, gram, n, own): interpolated modified Kneser-Ney, learned from own.

    Of n-grams shorter than ORDER it counts in how many contexts each is seen. N-grams that were not learned back off to
    the shorter ones, at last to one in 2 ** 16. All levels are joins and sums of rows, one for each n-gram or context;
    what is collected is a few counts of counts for each language and level.
    """
    spark = counts.sparkSession
    levels = {ORDER: counts.where("own > 0").select("lang", F.col("gram").alias("key"), F.col("own").alias("c"))}
    needed = {ORDER: counts.select("lang", F.col("gram").alias("key"))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = staged(levels[k + 1].select("lang", _last(F.col("key"), k).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("c")), f"level{k}")
        needed[k] = staged(needed[k + 1].select("lang", _last(F.col("key"), k).alias("key")).distinct(), f"needed{k}")
    few: dict[tuple[str, int], dict[int, int]] = {}
    of_few = [levels[k].groupBy("lang", F.lit(k).alias("k"), F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("n")) for k in levels]
    for r in of_few[0].union(of_few[1]).union(of_few[2]).union(of_few[3]).collect():
        few.setdefault((r.lang, r.k), {})[r.c] = r.n
    off = spark.createDataFrame([(lang, k, *discounts(n)) for (lang, k), n in few.items()], "lang string, k int, d1 double, d2 double, d3 double")
    below = None
    for k in range(1, ORDER + 1):
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = levels[k].join(F.broadcast(off.where(F.col("k") == k).drop("k")), "lang").select("lang", "key", "c", taken.alias("off"))
        context = F.shiftrightunsigned(F.col("key"), BITS)
        sums = level.groupBy("lang", context.alias("context")).agg(F.sum("c").alias("total"), F.sum("off").alias("rest"))
        out = needed[k].withColumn("context", context).join(level, ["lang", "key"], "left").join(sums, ["lang", "context"], "left")
        if below is None:
            out = out.withColumn("below", F.lit(2.0**-BITS))
        else:
            out = out.withColumn("last", _last(F.col("key"), k - 1)).join(below, ["lang", "last"])
        p = F.coalesce((F.coalesce(F.col("c") - F.col("off"), F.lit(0.0)) + F.col("rest") * F.col("below")) / F.col("total"), F.col("below"))
        below = staged(out.select("lang", F.col("key").alias("last"), p.alias("below")), f"p{k}")
    return below.select("lang", F.col("last").alias("gram"), F.log("below").alias("logp"))


class SortedArrays:
    """A part of the model: for each language its n-grams' keys, sorted, and their log probabilities."""

    def __init__(self, table: pa.Table):
        self.of = {}
        for lang in pc.unique(table["lang"]).to_pylist():
            rows = table.filter(pc.equal(table["lang"], lang))
            keys, logp = rows["gram"].to_numpy(), rows["logp"].to_numpy().astype(np.float32)
            order = np.argsort(keys)
            self.of[lang] = keys[order], logp[order]

    def score(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probabilities; 0 for keys of other parts."""
        if lang not in self.of:
            return np.zeros(len(keys))
        known, logp = self.of[lang]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, logp[at], 0).astype(np.float64)


def _repeated(words: pa.Array, at: np.ndarray, k: int = 5) -> np.ndarray:
    """For each text, its words that stand in k words in a row found twice or more in it."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in strings(coded.dictionary)], np.uint64)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    n = max(0, len(own) - k + 1)
    h = doc[:n].astype(np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    inside = np.flatnonzero(doc[:n] == doc[k - 1 :]) if n else np.zeros(0, np.int64)
    _, group, times = np.unique(h[inside], return_inverse=True, return_counts=True)
    starts = inside[times[group] > 1]
    cover = np.zeros(len(own) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + k, -1)
    marked = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return marked[at[1:]] - marked[at[:-1]]


def _repeated_lines(text: pa.Array) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier one."""
    lines = pc.split_pattern(text.cast(pa.large_string()), "\n")
    coded = pc.list_flatten(lines).dictionary_encode()
    full = np.array([bool(x.strip(" \t\r\x0b\x0c")) for x in strings(coded.dictionary)], bool)
    index = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(text)), pc.list_value_length(lines).to_numpy())
    keep = full[index] if len(index) else np.zeros(0, bool)
    doc, index = doc[keep], index[keep]
    distinct = np.unique(doc * max(len(full), 1) + index) // max(len(full), 1)
    return np.bincount(doc, minlength=len(text)) - np.bincount(distinct, minlength=len(text))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")
_COLUMNS = "row_no long, doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", plain boolean, logp double"


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, plain, log_perplexity) for every row of docs.

    A character model of each language (a null one is a language of its own) is counted over all rows, learned from
    the plain ones and scores all; log perplexity is the mean over all characters, null for a text without any. Null
    texts are empty; repeated rows count and stay; an empty table gives no rows. The model grows with the corpus; it is
    sent in parts of at most MODEL_ROWS n-grams by a hash of their keys, and each part scores all documents in a pass of
    its own: docs must give the same rows each time.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    model = kneser_ney(staged(count_ngrams(own.select("lang", "text")), "ngrams"))
    passes = max(1, -(-model.count() // MODEL_ROWS))
    parts = [_scored(own, model.where(F.pmod(F.xxhash64("lang", "gram"), F.lit(passes)) == p)) for p in range(passes)]
    out = parts[0]
    if passes > 1:
        for p in parts[1:]:
            out = out.union(p)
        rest = [c for c in out.columns if c not in ("row_no", "logp")]
        out = out.groupBy("row_no").agg(*[F.first(c).alias(c) for c in rest], F.sum("logp").alias("logp"))
    return out.withColumn("log_perplexity", F.when(F.col("n_chars") > 0, -F.col("logp") / F.col("n_chars"))).drop("row_no", "logp")


def _scored(own: DataFrame, part: DataFrame) -> DataFrame:
    sent = own.sparkSession.sparkContext.broadcast(SortedArrays(part.toArrow()))
    names = [x.split()[0] for x in _COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch in slices(whole):
                m, langs = Measured(batch["text"]), np.array(strings(batch["lang"]), object)
                m.n_dup_lines = _repeated_lines(batch["text"])
                keys, row = grams(m.points, m.cuts), np.repeat(np.arange(batch.num_rows), m.n_chars)
                logp = np.zeros(len(keys))
                for lang in set(langs):
                    mine = (langs == lang)[row]
                    logp[mine] = model.score(lang, keys[mine])
                sums = np.bincount(row, logp, minlength=batch.num_rows)
                counts = [pa.array(getattr(m, c).astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([batch["row_no"], batch["doc_id"], batch["lang"], *counts, pa.array(m.plain), pa.array(sums)], names)

    return own.mapInArrow(run, _COLUMNS)


def bands(measured: DataFrame) -> DataFrame:
    """(lang, middle, reach): the median of a language's rounded log perplexities over plain texts, and their quartile range."""
    rounded = measured.where("log_perplexity is not null and plain").groupBy("lang", F.round(F.col("log_perplexity") * 1000).cast("long").alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    share = rounded.withColumn("share", upto / F.sum("n").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("x"))) / 1000
    quartiles = share.groupBy("lang").agg(at(0.25).alias("a"), at(0.5).alias("m"), at(0.75).alias("b"))
    reach = F.greatest(F.col("b") - F.col("a"), F.lit(0.01))
    return quartiles.select("lang", F.col("m").alias("middle"), reach.alias("reach"))


def judge(docs: DataFrame) -> DataFrame:
    """measures() with base_failed, low, high and kept for every row of docs.

    base_failed: fewer than 10 words, or over a fifth of them repeated. kept: not base_failed, and the log perplexity
    is within its language's band: from low to high around the median, wider for short texts as their means vary more.
    """
    measured = staged(measures(docs), "measures")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    reach = F.col("reach") * F.sqrt(1 + SHORT_CHARS / F.greatest(F.col("n_chars"), F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    limited = measured.join(staged(bands(measured), "bands"), "lang", "left").withColumns({"low": F.col("middle") - BELOW * reach, "high": F.col("middle") + ABOVE * reach})
    return limited.drop("middle", "reach").withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
