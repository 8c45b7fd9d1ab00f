"""Contexts of questions from what retrieval found, and sections of flattened configurations.

Rows of one question, or of one section of a device, meet in one task; retrieval's depth and a device bound them. Empty
tables give no rows.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.configs import masked

#: What a document's head leaves out.
HIDDEN = ("file_path", "source", "filename", "source_directory")


def contexts(found: DataFrame) -> DataFrame:
    """(qid, context) of found(qid, rank, text, meta map<string, string>): heads and texts in order of rank."""
    shown = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*HIDDEN))
    head = F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    part = F.concat(F.lit("[METADATA]\n"), head, F.lit("\n\n[CONTENT]\n"), F.coalesce("text", F.lit("")))
    rows = found.select("qid", F.struct("rank", part.alias("part")).alias("r")).groupBy("qid").agg(F.array_sort(F.collect_list("r")).alias("l"))
    return rows.select("qid", F.array_join(F.transform("l", lambda x: x["part"]), "\n\n").alias("context"))


def reranked(found: DataFrame, answers: DataFrame, top: int) -> DataFrame:
    """(qid, rank, doc_id): found(qid, rank, doc_id) in the order in which answers(qid, text) names Doc[n], n from 1.

    Numbers without a document are dropped, repeats stay; a question whose answer names none keeps its first ones.
    """
    numbers = answers.select("qid", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)Doc\s*\[(\d{1,6})\]"), 1)).alias("no", "n")).select("qid", "no", F.col("n").cast("int").alias("rank"))
    named = numbers.join(found.select("qid", "rank", "doc_id"), ["qid", "rank"]).select("qid", "no", "doc_id")
    rest = found.join(named.select("qid").distinct(), "qid", "left_anti").select("qid", F.col("rank").alias("no"), "doc_id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("no", "doc_id"))
    return named.union(rest).withColumn("place", place).where(F.col("place") <= top).select("qid", F.col("place").alias("rank"), "doc_id")


def merged(found: DataFrame, top: int = 3) -> DataFrame:
    """(qid, rank, doc_id) of found(qid, query_no, rank, doc_id): the first distinct documents over a question's queries."""
    best = found.groupBy("qid", "doc_id").agg(F.min(F.struct("query_no", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at", "doc_id"))
    return best.withColumn("place", place).where(F.col("place") <= top).select("qid", F.col("place").alias("rank"), "doc_id")


def batch_requests(questions: DataFrame, model: str) -> DataFrame:
    """(value): a JSON line for each of questions(qid, question), its custom_id the qid."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"))
    return questions.select(F.to_json(F.struct(F.col("qid").cast("string").alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


def _leaves(node: ET.Element, prefix: str) -> Iterator[tuple[str, str]]:
    counts: dict[str, int] = {}
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    own = list(node)
    often = {t for t in map(name, own) if sum(name(e) == t for e in own) > 1} if len(own) < 200 else {name(e) for e in own}
    for child in own:
        tag = name(child)
        counts[tag] = counts.get(tag, 0) + 1
        label = next((e.text.strip() for e in child if name(e) == "name" and e.text and e.text.strip()), str(counts[tag])) if tag in often else None
        path = f"{prefix}/{tag}" + (f"[{label}]" if label else "")
        if len(child):
            yield from _leaves(child, path)
        else:
            yield path, (child.text or "").strip()


def flattened(documents: DataFrame) -> DataFrame:
    """(file, no, path, value) of documents(file, text) in XML: every leaf in order; repeated elements bear their name, or their number.

    Secrets are masked. A text that isn't XML has the one row with path '' and its error as value; null texts have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"]):
                try:
                    leaves = list(_leaves(ET.fromstring(text), ""))
                except ET.ParseError as e:
                    leaves = [("", str(e))]
                rows += [(file, no, path.lstrip("/"), value) for no, (path, value) in enumerate(leaves)]
            yield pd.DataFrame(rows, columns=["file", "no", "path", "value"])

    out = documents.select("file", "text").where("text is not null").mapInPandas(run, "file string, no long, path string, value string")
    return out.withColumn("value", masked(F.element_at(F.split("path", "/"), -1), F.col("value")))


def section_texts(leaves: DataFrame, depth: int = 1) -> DataFrame:
    """(file, section, text): lines 'path: value' of the leaves under each path of that depth, in order."""
    section = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    rows = leaves.select("file", section.alias("section"), F.struct("no", F.concat("path", F.lit(": "), "value").alias("line")).alias("r"))
    return rows.groupBy("file", "section").agg(F.array_sort(F.collect_list("r")).alias("l")).select("file", "section", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


#: Sections that come first, in this order, and those that are split below their name.
SECTION_ORDER = ("hostname", "tailfned", "version", "service", "enable", "clock", "ip", "multilink", "username", "redundancy", "control-plane", "config-register", "logging", "router", "interface", "line")
SPLIT_SECTIONS = ("interface", "line")


def section_documents(leaves: DataFrame, devices: DataFrame, order: tuple[str, ...] = SECTION_ORDER, split: tuple[str, ...] = SPLIT_SECTIONS) -> DataFrame:
    """(file, place, section, text): a document for each section of each file's leaves(file, no, path, value), a split one for each of its instances.

    Texts have a header with the section, devices(file, device_name) and the file, then lines `path: value` in order.
    place, from 0, follows the order list, then the first leaf. Leaves of a file without a device name bear the file's.
    """
    top = F.split_part("path", F.lit("/"), F.lit(1))
    bare = F.regexp_replace(top, r"\[.*$", "")
    section = F.when(bare.isin(*split), F.array_join(F.slice(F.split("path", "/"), 1, 2), "_")).otherwise(top)
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), bare) if order else F.lit(0)
    rows = leaves.where("path <> ''").select("file", section.alias("section"), F.when(rank == 0, len(order) + 1).otherwise(rank).alias("rank"), "no", F.concat("path", F.lit(": "), F.coalesce("value", F.lit(""))).alias("line"))
    made = rows.groupBy("file", "section").agg(F.min("rank").alias("rank"), F.min("no").alias("first"), F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("rank", "first")) - 1
    named = made.withColumn("place", place).join(devices.select("file", "device_name"), "file", "left")
    head = F.concat(F.lit("[METADATA]\nsection: "), F.col("section"), F.lit("\ndevice_name: "), F.coalesce("device_name", "file"), F.lit("\nsource: "), F.col("file"), F.lit("\n\n[CONTENT]\n[SECTION] "), F.col("section"), F.lit("\n"))
    return named.select("file", F.col("place").cast("long").alias("place"), "section", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def filled_budget(items: DataFrame, budget: DataFrame) -> DataFrame:
    """(category, missing): what budget(category, need) asks for and items(category) lack; nothing for categories with enough."""
    have = items.groupBy("category").agg(F.count("*").alias("n"))
    return budget.join(have, "category", "left").select("category", (F.col("need") - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")
