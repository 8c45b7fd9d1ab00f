"""Answers as text, and the text rules of evaluation: cleaning, sections and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean yes and no.
YES, NO = ("true", "yes", "1", "enabled", "active", "on"), ("false", "no", "0", "disabled", "inactive", "off")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed a single time, however often f names it, in functions of items too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def falsy(c: Column) -> Column:
    """Null and empty are alike."""
    return c.isNull() | (c == "")


def or_else(c: Column, other: str = "") -> Column:
    return F.when(falsy(c), F.lit(other)).otherwise(c)


def set_text(values: Column) -> Column:
    """Sorted distinct values, joined."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ", ")


def map_text(pairs: Column) -> Column:
    """k=v entries of array<struct<k, v>>, sorted and joined."""
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"]))), ", ")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_boolean(text: Column) -> Column:
    low = F.lower(stripped(text))
    return F.when(low.isin(*YES), "true").when(low.isin(*NO), "false").otherwise(low)


def flatten_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tag(text: Column) -> Column:
    """A question without its leading [tag]."""
    return F.trim(F.regexp_replace(text, r"^\s*\[[^\]]+\]\s*", ""))


def clean_truth(text: Column) -> Column:
    """A ground truth without tag, label and outer quotes."""
    out = F.regexp_replace(text, r"(?i)\[/?ground_truth\]", "")
    out = F.regexp_replace(F.trim(out), r"(?i)^(ground[ _]?truth|answer)\s*[:=]\s*", "")
    return flatten_space(F.regexp_replace(F.trim(out), "^[\"'`]+|[\"'`]+$", ""))


def sections(answer: Column) -> Column:
    """struct<truth, explanation> of a tagged answer; an untagged one explains all, and is the truth too up to ten words."""
    truth = F.regexp_extract(answer, r"(?is)\[GROUND_TRUTH\](.*?)(?:\[EXPLANATION\]|$)", 1)
    explanation = F.regexp_extract(answer, r"(?is)\[EXPLANATION\](.*)$", 1)
    tagged = F.rlike(answer, F.lit(r"(?i)\[(GROUND_TRUTH|EXPLANATION)\]"))
    short = F.size(F.split(F.trim(answer), r"\s+")) <= 10
    return F.struct(
        F.trim(F.when(tagged, truth).when(short, answer).otherwise("")).alias("truth"),
        F.trim(F.when(tagged, explanation).otherwise(answer)).alias("explanation"),
    )


def citations(text: Column) -> Column:
    """File names of the last [CITATIONS] line."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^\[CITATIONS\][:\s]*(.*)$"), 1)
    last = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))
    return F.filter(F.transform(F.split(last, r"[,;]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def html_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>", " ")
    return flatten_space(F.regexp_replace(out, r"<[^>]*>", " "))


def equal_chunks(text: Column, size: int) -> Column:
    """array<struct<chunk, text>>: one piece more than size goes into the text, of equal length, what is left over spread over the first; an empty text is one empty piece, null none."""
    n = F.length(text)
    k = F.floor(n / size) + 1
    each, extra = F.floor(n / k).cast("int"), (n % k).cast("int")

    def cut(part: Column, length: Column) -> Column:
        return F.when(length > 0, F.regexp_extract_all(part, F.concat(F.lit("(?s).{"), length, F.lit("}")), F.lit(0))).otherwise(F.array(F.lit("")))

    def pieces(p: Column) -> Column:
        """The first extra pieces are longer by one; each part is cut in one pass."""
        head = p["extra"] * (p["each"] + 1)
        longer = F.when(p["extra"] > 0, cut(F.substring(p["text"], F.lit(1), head), p["each"] + 1)).otherwise(F.array().cast("array<string>"))
        return F.concat(longer, cut(F.substr(p["text"], head + 1), p["each"]))

    given = F.struct(text.alias("text"), each.alias("each"), extra.alias("extra"))
    listed = F.transform(once(given, pieces), lambda t, i: F.struct(i.cast("long").alias("chunk"), t.alias("text")))
    return F.when(text.isNotNull(), listed)


def plain_text(json: Column) -> Column:
    """JSON as plain text: entries of an object as `k: v`, items of a list, joined by ", "; a null, missing or empty value is empty; other text as it stands."""
    shape = F.coalesce(F.schema_of_variant(F.try_parse_json(json)), F.lit(""))
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    told = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), ", ")
    items = F.array_join(F.transform(F.from_json(json, "array<string>"), lambda x: F.coalesce(x, F.lit(""))), ", ")
    scalar = F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", "string"), F.lit(""))
    return F.when(shape.startswith("OBJECT"), told).when(shape.startswith("ARRAY"), items).when(shape == "", F.coalesce(json, F.lit(""))).otherwise(scalar)


def raw_answer(answer_type: Column, answer: Column) -> Column:
    """An answer's text as JSON of its type: an array of a set or list, an object of a map, a number, true or false; other text as a JSON string, null as null."""
    at, items = F.lower(F.coalesce(answer_type, F.lit(""))), F.filter(F.split(answer, ", "), lambda x: x != "")
    pairs = F.map_from_entries(F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.locate("=", x) + F.lit(1), F.length(x)).alias("v"))))
    whole = F.to_json(F.array(answer))
    text = F.substring(whole, F.lit(2), F.length(whole) - 2)
    simple = F.when(at.isin("numeric", "number") & answer.try_cast("double").isNotNull(), answer).when((at == "boolean") & F.lower(answer).isin("true", "false"), F.lower(answer)).otherwise(text)
    return F.when(answer.isNull(), "null").when(at.isin("set", "list"), F.to_json(items)).when(at.isin("map", "dict"), F.to_json(pairs)).otherwise(simple)
