"""Text of devices and of models, as columns: paths, ping and traceroute, configurations, secrets, JSON in prose. A null gives a null unless it is said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import stripped

#: Parts of keys whose values are secrets, prompts and echoes of a controller's shell, and what only a configuration begins with.
SECRET_KEYS = ("secret", "password", "key-data", "private-key")
PROMPTS = ("admin@ncs#", "admin@ncs%", "live-status exec", "devices device")
BEGINNINGS = ("version", "Building configuration")
ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def normal_path(path: Column) -> Column:
    """A path without outer or repeated slashes."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def traceroute_path(text: Column) -> Column:
    """All addresses in order, each once; none for a null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ADDRESS), 0))


def ping_loss(text: Column) -> Column:
    """Percent lost by 'Success rate is n percent (a/b)' or 'a packets transmitted, b received'; 100 without such a line or with none sent."""
    pick = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("int")
    short, long = r"\((\d{1,9})/(\d{1,9})\)", r"(\d{1,9}) packets transmitted, (\d{1,9}) (?:packets )?received"
    got, sent = F.coalesce(pick(short, 1), pick(long, 2)), F.coalesce(pick(short, 2), pick(long, 1))
    return F.when(sent > 0, 100.0 * (sent - got) / F.greatest(sent, F.lit(1))).otherwise(100.0)


def ping_stats(text: Column) -> Column:
    """struct(received, sent, loss, low, mean, high) of a reply: counts as in ping_loss, times from 'min/avg/max = a/b/c ms'; null where the text has none."""
    pick = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("long")
    short, long, times = r"\((\d{1,9})/(\d{1,9})\)", r"(\d{1,9}) packets transmitted, (\d{1,9}) (?:packets )?received", r"= (\d{1,9})/(\d{1,9})/(\d{1,9})"
    got, sent = F.coalesce(pick(short, 1), pick(long, 2)), F.coalesce(pick(short, 2), pick(long, 1))
    return F.struct(got.alias("received"), sent.alias("sent"), F.round(ping_loss(text), 2).alias("loss"), *[pick(times, i).alias(n) for i, n in ((1, "low"), (2, "mean"), (3, "high"))])


def masked(key: Column, value: Column, mark: str = "***") -> Column:
    """The mark for values whose key speaks of a secret, whatever its case."""
    return F.when(F.rlike(F.lower(key), F.lit("|".join(SECRET_KEYS))), F.lit(mark)).otherwise(value)


def clean_config(raw: Column) -> Column:
    """A configuration without the shell's prompts and echoes, from its first own line on.

    That is the line after one that starts with 'result', a comment ('!'), or one that tells a version. Without such a
    line nothing is left.
    """
    has = lambda line, parts: F.rlike(line, F.lit("|".join(parts)))
    prompt = lambda x: has(x, PROMPTS) | F.rlike(x, F.lit(r"^\s*\S*#\s*$"))
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: ~prompt(x))
    begins = lambda x: F.startswith(F.trim(x), F.lit("result")) | F.startswith(x, F.lit("!")) | has(x, BEGINNINGS)
    first = F.array_position(F.transform(lines, begins), True)
    own = F.filter(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), lambda x: ~F.startswith(F.trim(x), F.lit("result")))
    return F.when(raw.isNull(), None).when(first > 0, F.array_join(own, "\n")).otherwise("")


def first_three(values: Column) -> Column:
    """A list as its first three values and how many there are in all."""
    told = F.array_join(F.slice(values, 1, 3), ", ")
    return F.when(F.size(values) > 3, F.concat(told, F.lit(" ... ("), F.size(values).cast("string"), F.lit(" in all)"))).otherwise(told)


def metric_of_id(name: Column) -> Column:
    """The capitals and underscores before an id's number; '' if there are none."""
    return F.regexp_extract(name, r"([A-Z_]+)_\d+", 1)


def json_in(text: Column) -> Column:
    """The JSON in a text: that of a code block, else from the first opening to the last closing bracket; null if it isn't valid."""
    block = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    widest = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    valid = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), stripped(x))
    return F.coalesce(valid(block), valid(text), valid(widest(r"(?s)\{.*\}")), valid(widest(r"(?s)\[.*\]")))


def complexity(devices: Column, protocols: Column, vrfs: Column, links: Column) -> Column:
    """struct<score, band> of a network by weighted counts."""
    score = 0.3 * devices + 0.2 * protocols + 0.3 * vrfs + 0.2 * links
    return F.struct(score.alias("score"), F.when(score < 10, "simple").when(score < 30, "medium").otherwise("complex").alias("band"))


#: What a line of the shell around an XML answer holds.
XML_PROMPTS = ("admin@ncs#", "admin@ncs%")


def clean_xml(raw: Column) -> Column:
    """An XML answer without the shell's prompts and show commands, from the first line that begins with a tag; nothing if there is none, null for null."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: ~F.rlike(x, F.lit("|".join(XML_PROMPTS))) & ~F.startswith(F.ltrim(x), F.lit("show ")))
    first = F.array_position(F.transform(lines, lambda x: F.startswith(F.ltrim(x), F.lit("<"))), True)
    return F.when(raw.isNull(), None).when(first > 0, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")).otherwise("")
