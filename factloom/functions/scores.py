"""Scores of answers against truths, as columns. A null is an empty text; blanks are those of ASCII; every score is 0 to 1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from factloom.functions.text import normalize_boolean, once, stripped


def words(text: Column) -> Column:
    """The words between blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def items(text: Column, separators: str = ",") -> Column:
    """The distinct values between separators, blank ones left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), f"[{separators}]"), stripped)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def _f1(p: Column, t: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays of distinct values: 2 shared / all; both_empty if there are none at all."""
    total = F.size(p) + F.size(t)
    return F.when(total == 0, F.lit(both_empty)).otherwise(2.0 * F.size(F.array_intersect(p, t)) / F.greatest(total, F.lit(1)))


def _same(p: Column, t: Column) -> Column:
    return F.array_sort(p) == F.array_sort(t)


def _normal_items(text: Column) -> Column:
    return F.array_distinct(F.transform(items(text), normalize_boolean))


def exact_match(prediction: Column, truth: Column, booleans: bool = True) -> Column:
    """1 if equal but for case, outer blanks and, with booleans, words that mean yes or no."""
    low = normalize_boolean if booleans else lambda c: F.lower(stripped(c))
    norm = lambda c: low(F.coalesce(c, F.lit("")))
    return (norm(prediction) == norm(truth)).cast("int")


def relaxed_match(prediction: Column, truth: Column) -> Column:
    """1 if the sets of comma-separated values are equal."""
    return _same(_normal_items(prediction), _normal_items(truth)).cast("int")


def token_f1(prediction: Column, truth: Column, booleans: bool = True) -> Column:
    """F1 of the distinct words in lower case; 1 if both have none, 0 if one has none."""
    low = normalize_boolean if booleans else F.lower
    tokens = lambda c: F.array_distinct(words(low(F.coalesce(c, F.lit("")))))
    return _f1(tokens(prediction), tokens(truth))


def relaxed_f1(prediction: Column, truth: Column) -> Column:
    """F1 of the comma-separated values; 1 if both have none."""
    return _f1(_normal_items(prediction), _normal_items(truth))


def _listed(prediction: Column, truth: Column) -> Column:
    return F.rlike(F.concat(F.coalesce(prediction, F.lit("")), F.coalesce(truth, F.lit(""))), F.lit("[,;]"))


def list_match(prediction: Column, truth: Column) -> Column:
    """1 if equal as sets of values between commas or semicolons; without such marks, as texts."""
    as_sets = _same(items(prediction, ",;"), items(truth, ",;"))
    return F.when(_listed(prediction, truth), as_sets).otherwise(F.coalesce(prediction, F.lit("")) == F.coalesce(truth, F.lit(""))).cast("int")


def list_f1(prediction: Column, truth: Column) -> Column:
    """F1 of the values between commas or semicolons; without such marks, of the words. Nothing against nothing is 0."""
    of_items = _f1(items(prediction, ",;"), items(truth, ",;"), 0.0)
    of_words = _f1(F.array_distinct(words(prediction)), F.array_distinct(words(truth)), 0.0)
    return F.when(_listed(prediction, truth), of_items).otherwise(of_words)


def rouge_n(prediction: Column, truth: Column, n: int) -> Column:
    """F1 of the distinct n-grams of words; texts of fewer words have none, and nothing against nothing is 0."""

    def grams(text: Column) -> Column:
        joined = lambda w: F.transform(w, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))
        return once(words(text), lambda w: F.array_distinct(F.slice(joined(w), F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0)))))

    return once(grams(prediction), lambda p: once(grams(truth), lambda t: _f1(p, t, 0.0)))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        met = row & places.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words; nothing against nothing is 0."""

    def score(p: str | None, t: str | None) -> float:
        x, y = (p or "").split(), (t or "").split()
        return 2.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 0.0

    return pd.Series([score(p, t) for p, t in zip(prediction, truth)], dtype="float64")


def support_at_k(citations: Column, files: Column) -> Column:
    """Whether a citation is one of the files' names, whatever the case, or holds the number of one, from 1; null lists are empty."""
    none = F.array().cast("array<string>")
    names = F.transform(F.coalesce(files, none), lambda f: F.lower(stripped(f)))

    def cited(c: Column) -> Column:
        low = F.lower(stripped(F.coalesce(c, F.lit(""))))
        number = F.regexp_extract(low, r"(\d+)", 1).try_cast("int")
        return (low != "") & (F.array_contains(names, low) | F.coalesce(number.between(1, F.size(names)), F.lit(False)))

    return F.coalesce(F.exists(F.coalesce(citations, none), cited), F.lit(False))


def recall_at(files: Column, truth: Column, k: int) -> Column:
    """1 if one of the comma-separated true files is among the first k; 0 if there are none."""
    named = F.slice(F.transform(F.coalesce(files, F.array().cast("array<string>")), stripped), 1, k)
    return F.coalesce(F.arrays_overlap(named, items(truth)), F.lit(False)).cast("double")


def reciprocal_rank(files: Column, truth: Column) -> Column:
    """1 / place of the first true file; 0 if there is none."""
    named = F.transform(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.coalesce(stripped(f), F.lit("")))
    places = F.filter(F.transform(items(truth), lambda x: F.array_position(named, x)), lambda p: p > 0)
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))
