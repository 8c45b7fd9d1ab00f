"""License scans: ordered signature rules behind a keyword prefilter, longest detections first. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import BASE, UNDER, _words, rules
from .spans import running_sums

#: Words before and after A-Z are made lower case, and texts that can hold a phrase of any rule.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What the sentences hold that hold none of the other words.
SENTENCE_WORDS = "advertising|software|copyright|consequential|perpetual|remotely|linking|invariant|mpl|package|perl|executable|relinquishment|fuck|publicdomain|mozilla|fonts|parties|reproduced|unauthorized|secrets"
PREFILTER = rf"(?i)licen[cs]e|(?:{'|'.join(UNDER)}){_GAP}under|spdx|cc{_GAP}by|reserved|public{_GAP}domain|permission|redistribution|commercial|confidential|warranty|{SENTENCE_WORDS}"

_NONE = "array<struct<start:int,back:int,rank:int,label:string,weight:double>>"


def _n_words(s: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("int")


def _spaced(text: Column) -> Column:
    """The words of a text, lower case, each with a blank on both sides."""
    words = F.trim(F.regexp_replace(ascii_lower(text), SEPARATOR, " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _detected(spaced: Column, rule: Column) -> Column:
    """A rule's detections: first word, minus the end (so that longer ones sort first), rank, label, weight."""
    found = F.regexp_extract_all(spaced, rule["regex"], F.lit(0))
    gaps = F.split(spaced, rule["regex"], -1)

    def built(p: Column) -> Column:
        sums = running_sums(F.zip_with(F.slice(p["gaps"], 1, F.size(p["found"])), p["found"], lambda g, m: _n_words(g) + _n_words(m)))
        at = lambda i: F.get(sums, i) + _n_words(F.get(p["gaps"], i))
        return F.transform(p["found"], lambda m, i: F.struct(at(i).alias("start"), (-at(i) - _n_words(m)).alias("back"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["weight"].alias("weight")))

    return F.when(F.size(found) == 0, F.array().cast(_NONE)).otherwise(F.element_at(F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), built), 1))


def _rule_array(rows: list[tuple[str, str, str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(r).alias("regex"), F.lit(n).alias("rank"), F.lit(label).alias("label"), F.lit(w).alias("weight")) for n, (k, r, label, w) in enumerate(rows)])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    A document that passes the prefilter is searched for the base phrases and for the rules whose keyword it holds.
    Detections are taken by first word, the longer first, then by rule order; one that lies within a stretch already
    taken is suppressed. Base labels stay. score is the largest weight of what stays, 1 with a base phrase, 0 without
    any. Null and empty texts have no words; repeated rows and rows without doc_id are scanned as any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(text.rlike(PREFILTER), _spaced(text)).alias("spaced"))
    spaced = F.col("spaced")
    none = F.array().cast(_NONE)
    base = F.flatten(F.transform(F.filter(_rule_array([("", _words(p), label, 1.0) for p, label in BASE]), lambda r: F.rlike(spaced, r["regex"])), lambda r: _detected(spaced, r)))
    more = F.flatten(F.transform(F.filter(_rule_array(rules()), lambda r: spaced.contains(r["keyword"])), lambda r: _detected(spaced, r)))
    found = own.select("doc_id", "n_words", F.when(spaced.isNull(), none).otherwise(base).alias("base"), F.when(spaced.isNull(), none).otherwise(F.array_sort(more)).alias("more"))

    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        new = -d["back"] > acc["upto"]
        return F.struct(
            F.greatest(acc["upto"], -d["back"]).alias("upto"),
            F.when(new, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(new, F.greatest(acc["score"], d["weight"])).otherwise(acc["score"]).alias("score"),
        )

    kept = found.withColumn("kept", F.aggregate("more", start, step))
    base_labels = F.array_distinct(F.transform("base", lambda d: d["label"]))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    return kept.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("kept.labels"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.col("kept.score")).alias("score"),
    )
