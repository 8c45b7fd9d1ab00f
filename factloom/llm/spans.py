"""Places of regular-expression matches in texts, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values whose running sums are built together: a fold copies what it has built, so its cost is kept to this length.
_BLOCK = 128


def running_sums(values: Column) -> Column:
    """For an array<int>: the sum before each element."""

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    inner = F.transform(parts, fold)
    bases = fold(F.transform(inner, lambda p: F.element_at(p, -1)))
    shifted = F.zip_with(inner, F.slice(bases, 1, F.size(inner)), lambda p, base: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + base))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.flatten(shifted))


def matches(text: Column, regex: Column | str) -> Column:
    """array<struct<start int, end int, value string, before string, after string>> of a regex's matches, left to right.

    start and end count code points, end exclusive; before and after are the texts between neighbouring matches.
    The regex must not match an empty string.
    """
    pattern = F.lit(regex) if isinstance(regex, str) else regex
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    return _placed(F.struct(found.alias("found"), gaps.alias("gaps")))


def _placed(s: Column) -> Column:
    """From matches and the gaps around them."""

    def built(p: Column) -> Column:
        n = F.size(p["found"])
        steps = F.zip_with(F.slice(p["gaps"], 1, n), p["found"], lambda g, m: F.length(g) + F.length(m))
        sums = running_sums(steps)
        return F.transform(
            p["found"],
            lambda m, i: F.struct(
                (F.get(sums, i) + F.length(F.get(p["gaps"], i))).alias("start"),
                (F.get(sums, i) + F.length(F.get(p["gaps"], i)) + F.length(m)).alias("end"),
                m.alias("value"),
                F.get(p["gaps"], i).alias("before"),
                F.get(p["gaps"], i + 1).alias("after"),
            ),
        )

    return F.element_at(F.transform(F.array(s), built), 1)


def kept_spans(found: Column, kind: str, rank: int) -> Column:
    """array<struct<start, rank, end, kind>>: spans as they sort."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def rendered(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
