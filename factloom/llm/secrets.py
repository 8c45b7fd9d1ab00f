"""Secrets by a trigram inverted index: postings of what the rules demand, intersected, then verified. SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name
from .secret_rules import ANY_CASE, BASE, RULES, trigram_query
from .spans import kept_spans, matches, rendered

MASK = "[SECRET]"


def _java(kind: str, pattern: str) -> str:
    """The pattern as Spark's functions take it; word letters in either case for the rules that ask for it."""
    return pattern.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))") if kind in ANY_CASE else pattern


def postings(low: Column) -> Column:
    """The trigrams that some rule's query names and a text in lower case holds. low is named often: a column, not an expression."""
    grams = sorted({t for _, p, _, _ in RULES for group in trigram_query(p) for alternative in group for t in alternative})
    return F.array_compact(F.array(*[F.when(low.contains(g), F.lit(g)) for g in grams]))


def candidate(held: Column, k: int) -> Column:
    """Whether a text with these trigrams can match rule k: of each part of its query all trigrams of one alternative are there."""
    every = lambda columns: reduce(Column.__and__, columns)
    some = lambda columns: reduce(Column.__or__, columns)
    return every([some([every([F.array_contains(held, t) for t in alternative]) for alternative in group]) for group in trigram_query(RULES[k][1])])


def _found(text: Column, k: int) -> Column:
    """Verified matches of a rule; those too short are left out."""
    kind, pattern, group, least = RULES[k]
    java = _java(kind, pattern)
    value = lambda m: F.regexp_extract(m["value"], java, group) if group else m["value"]
    return kept_spans(F.filter(matches(text, java), lambda m: F.length(value(m)) >= least), kind, k)


def scan(docs: DataFrame, name: str = "spans") -> DataFrame:
    """docs with a column of that name: array<struct<start, rank, end, kind>> of all rules' matches, in code points, sorted.

    A rule whose regex demands trigrams is run on the texts whose postings its query meets, others on all; both are
    decided row by row, so nothing is shuffled and no key can be hot. Nulls are empty texts, rows keep their other
    columns (a column of that name is replaced) and their number, whatever their doc_id. An empty table gives no rows.
    """
    text, low, held = F.coalesce(F.col("text"), F.lit("")), free_name("low", docs.columns), free_name("held", docs.columns)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for k, (_, pattern, _, _) in enumerate(RULES):
        run = candidate(F.col(held), k) if trigram_query(pattern) else text.rlike(_java("", pattern))
        parts.append(F.when(run, _found(text, k)).otherwise(none))
    posted = docs.withColumn(low, ascii_lower(text)).withColumn(held, postings(F.col(low))).drop(low)
    return posted.withColumn(name, F.array_sort(F.concat(*parts))).drop(held)


def masked(text: Column, spans: Column) -> Column:
    """The text with MASK in the place of all spans; spans that overlap become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{RULES[k][0]}")
    base = F.sha2(rendered(F.filter("spans", lambda s: s["rank"] < BASE)), 256)
    return found.select("doc_id", *[n(k) for k in range(BASE)], base.alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def digest_sql() -> str:
    """digest() of documents in DuckDB's SQL."""

    def found(k: int) -> str:
        kind, pattern, group, least = RULES[k]
        regex = _java(kind, pattern).replace("'", "''")
        keep = f"length(regexp_extract(v, '{regex}', {group})) >= {least}"
        return f"""list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{
            's': list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0), 'v': m{k}[i]}}), lambda x: {keep.replace("(v,", "(x.v,")})"""

    quoted = [_java(kind, pattern).replace("'", "''") for kind, pattern, _, _ in RULES]
    cols = ", ".join(f"regexp_extract_all(t, '{q}') AS m{i}, string_split_regex(t, '{q}') AS g{i}" for i, q in enumerate(quoted))
    spans = " || ".join(f"list_transform({found(i)}, lambda x: {{'s': x.s::BIGINT, 'r': {i}, 'e': (x.s + length(x.v))::BIGINT, 'k': '{k}'}})" for i, (k, _, _, _) in enumerate(RULES))
    text = lambda xs: f"array_to_string(list_transform({xs}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.r = {i})) AS n_{RULES[i][0]}" for i in range(BASE))
    return f"""SELECT doc_id, {counts}, sha256(coalesce({text(f"list_filter(a, lambda x: x.r < {BASE})")}, '')) AS base_sha256, coalesce({text("a")}, '') AS spans
        FROM (SELECT doc_id, list_sort({spans}) AS a FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))"""
