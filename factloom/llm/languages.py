"""Language of web pages: text likelihoods, declared language, address suffix and host priors, fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, code_points, slices, staged, strings

#: Characters fall into 63 classes and one that stands before a text, so a language has at most 64 ** ORDER n-grams.
ORDER, CLASS_BITS, EDGE = 4, 6, 63
#: Characters that are counted into a language's n-grams before they are handed on.
FLUSH = 6_000_000
#: Documents of known language that the text model learns from at most: those of the smallest id hashes.
SAMPLE_ROWS = 20_000
#: Characters whose evidence counts in full: neighbouring n-grams are not independent, so a longer text says no more.
FULL_CHARS = 60
#: Pages that a wider level (domain, suffix, all pages) stands for in a narrower one, and added to each declared value.
SMOOTHING, ADDED = 5.0, 1.0


def visible_text(html: Column) -> Column:
    """What a page shows, without scripts, styles, navigation, asides and tags."""
    out = F.coalesce(html, F.lit(""))
    out = F.regexp_replace(out, r"(?is)<(script|style|noscript|nav|footer|header|aside)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"&[#A-Za-z0-9]{1,10};", " "), r"\s+", " "))


def addressed(pages: DataFrame) -> DataFrame:
    """page_id, row_no, host, domain, suffix, declared and text; what is missing is an empty string."""
    url = F.coalesce(F.lower("url"), F.lit(""))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    declared = F.regexp_extract(F.coalesce(F.lower("html"), F.lit("")), r"<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    own = pages.select("page_id", F.monotonically_increasing_id().alias("row_no"), host.alias("host"), declared.alias("declared"), visible_text(F.col("html")).alias("text"))
    return own.withColumns({"domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract("host", r"([^.]+)$", 1)})


def _class_table() -> np.ndarray:
    """The class of each code point: a-z 0 to 25, white space 26, digits 27, marks and punctuation 28 to 38, others by remainder."""
    out = np.full(0x110000, 39, np.int8)
    out += (np.arange(0x110000) % 24).astype(np.int8)
    for c in range(0x3000):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) != c:
            out[c] = out[ord(low)]
    for c in range(128):
        low = chr(c).lower()
        out[c] = ord(low) - 97 if "a" <= low <= "z" else 26 if low.isspace() else 27 if low.isdigit() else 28 + c % 11
    return out


_CLASSES = _class_table()


def _grams(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each character, its class and those of the ORDER - 1 before it in its text, as one number."""
    classes = _CLASSES[points].astype(np.int32)
    place = np.arange(len(points)) - np.repeat(cuts[:-1], np.diff(cuts))
    out = classes.copy()
    for k in range(1, ORDER):
        prior = np.full(len(points), EDGE, np.int32)
        prior[k:] = classes[:-k] if len(points) > k else prior[k:]
        prior[place < k] = EDGE
        out |= prior << (CLASS_BITS * k)
    return out


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, gram int, n long) over all rows (lang, text), counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            n = np.bincount(np.concatenate(held.pop(lang)))
            some = np.flatnonzero(n)
            size.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "gram", "n"])

        for whole in batches:
            for batch in slices(whole):
                langs = np.array(strings(batch["lang"]), object)
                points, cuts = code_points(batch["text"])
                grams = _grams(points, cuts)
                row = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
                for lang in sorted(set(langs)):
                    own = grams[(langs == lang)[row]]
                    held.setdefault(lang, []).append(own)
                    size[lang] = size.get(lang, 0) + len(own)
                    if size[lang] >= FLUSH:
                        yield flush(lang)
        for lang in sorted(held):
            yield flush(lang)

    return docs.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the sorted n-grams seen, and the log likelihood of each (rows) in each language, a last row for unseen ones."""
    known = docs.where("lang is not null and lang <> '' and text is not null").select("lang", "text", "doc_id")
    some = known.select("lang", "text", F.xxhash64("doc_id").alias("h"), "doc_id")
    cut = some.select("h").orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if cut is None:
        return [], np.zeros(0, np.int64), np.zeros((1, 0))
    counts = count_ngrams(some.where(F.col("h") <= cut).select("lang", "text")).toArrow()
    langs = sorted(set(strings(counts["lang"].combine_chunks())))
    at = np.array([langs.index(x) for x in strings(counts["lang"].combine_chunks())])
    keys, row = np.unique(counts["gram"].to_numpy(), return_inverse=True)
    table = np.full((len(keys) + 1, len(langs)), 0.5)
    np.add.at(table, (row, at), counts["n"].to_numpy())
    return langs, keys, np.log(table / table.sum(axis=0))


def with_text_posterior(pages: DataFrame, langs: list[str], keys: np.ndarray, logs: np.ndarray) -> DataFrame:
    """page columns but the text, with loglik: array<double>, a language's log likelihood of the text (zeros without text)."""
    sent = pages.sparkSession.sparkContext.broadcast((keys, logs))
    names = ["page_id", "row_no", "host", "domain", "suffix", "declared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = sent.value
        for whole in batches:
            for batch in slices(whole):
                points, cuts = code_points(batch["text"])
                grams = _grams(points, cuts)
                at = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
                at = np.where(keys[at] == grams, at, len(keys)) if len(keys) else np.zeros(len(grams), np.int64)
                n, row = np.diff(cuts), np.repeat(np.arange(batch.num_rows), np.diff(cuts))
                sums = np.stack([np.bincount(row, logs[at, k], minlength=batch.num_rows) for k in range(logs.shape[1])], axis=1) if logs.shape[1] else np.zeros((batch.num_rows, 0))
                sums *= (np.minimum(1, FULL_CHARS / np.maximum(n, 1)))[:, None]
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(sums.tolist(), pa.list_(pa.float64()))], [*names, "loglik"])

    return pages.select(*names, "text").mapInArrow(run, "page_id long, row_no long, host string, domain string, suffix string, declared string, loglik array<double>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _summed(pages: DataFrame, by: list[str], n: int) -> DataFrame:
    """For each group, the sum of its pages' text posteriors, language by language; added up in each task first."""
    sums = pages.groupBy(*by).agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)])
    return sums.select(*by, F.array(*[F.col(f"s{k}") for k in range(n)]).alias("sums"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host, suffix) for every row of pages.

    The posterior is the product of the text's likelihood, those of the declared language and of the suffix given a
    language, and the host's prior. Those are taken from all pages' text posteriors by grouped sums: a host's prior
    leans on its domain's, that on its suffix's, that on all pages', each by SMOOTHING pages; a page's own share is taken
    out of its host's and domain's sums. Ties go to the first language by name. Null or empty pages and addresses give
    no evidence of their kind; repeated rows count and stay. Without documents of known language, lang is null.
    """
    bounded_batches(pages.sparkSession)
    langs, keys, logs = text_model(docs)
    n = len(langs)
    measured = with_text_posterior(addressed(pages), langs, keys, logs)
    if not n:
        return measured.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "suffix")
    own = staged(measured.withColumn("p", _softmax(F.col("loglik"))), "pages")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    take = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    leaning = lambda sums, wide: F.transform(add(sums, F.transform(wide, lambda x: x * SMOOTHING)), lambda x: x / (total(sums) + SMOOTHING))

    declared, suffixes, domains, hosts = (staged(_summed(own, [c], n), c) for c in ("declared", "suffix", "domain", "host"))
    every = suffixes.agg(*[F.sum(F.col("sums")[k]) for k in range(n)]).first()
    every = [float(x or 0.0) for x in every]
    prior = F.array(*[F.lit((x + 1) / (sum(every) + n)) for x in every])
    kinds = {"declared": declared.count(), "suffix": suffixes.count()}

    def likelihood(c: str) -> Column:
        """Of a value of column c given each language; a missing value says nothing."""
        each = [F.log((F.col(f"{c}_sums")[k] + ADDED) / (every[k] + ADDED * kinds[c])) for k in range(n)]
        return F.when(F.col(c) == "", F.array(*[F.lit(0.0)] * n)).otherwise(F.array(*each))

    out = own
    for c, sums in (("declared", declared), ("suffix", suffixes), ("domain", domains), ("host", hosts)):
        out = out.join(sums.withColumnRenamed("sums", f"{c}_sums"), c)
    narrow = lambda c, wide: F.when(F.col(c) == "", wide).otherwise(leaning(take(F.col(f"{c}_sums"), F.col("p")), wide))
    host = narrow("host", narrow("domain", narrow("suffix", prior)))
    fused = _softmax(add(add(add(F.col("loglik"), likelihood("declared")), likelihood("suffix")), F.transform(host, lambda x: F.log(x))))
    named = F.array(*[F.lit(x) for x in langs])
    out = out.withColumn("fused", fused)
    first = lambda a: F.get(named, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return out.select("page_id", first(F.col("fused")).alias("lang"), F.array_max("fused").alias("confidence"), first(F.col("p")).alias("text_lang"), "declared", "host", "suffix")
