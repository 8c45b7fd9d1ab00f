"""Files of question datasets and their neighbours: policies, test data, splits, model outputs, inventories; and the writers.

Readers declare their schemas, so nothing is inferred by a pass over the files; absent fields are null, empty files give no
rows. Writers leave a folder of part files, as every Spark writer does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")
#: The columns of a dataset's two CSV forms, in order.
CSV_COLUMNS = ("id", "category", "answer_type", "level", "question", "ground_truth", "explanation", "source_files")
EVALUATION_COLUMNS = ("id", "origin", "level", "task_category", "answer_type", "complexity", "persona", "question", "ground_truth", "explanation", "context", "source_files")

ITEM = "id string, category string, answer_type string, level string, question string, ground_truth string, explanation string, source_files array<string>, origin string, complexity string, persona string, context string, task_category string"
POLICY_ITEM = "struct<goal: string, targets: array<string>, primary_metric: string, conditions: string, notes: string>"
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def policies(spark: SparkSession, path: str) -> DataFrame:
    """(no, category, level, item_no, goal, targets, primary_metric): a row for each item, in file order.

    Items lie in policies[].levels, a map of level to items. No targets mean GLOBAL.
    """
    raw = spark.read.schema(f"policies array<struct<category: string, levels: map<string, array<{POLICY_ITEM}>>>>").json(path, multiLine=True)
    of = raw.select(F.posexplode("policies").alias("no", "p")).select("no", "p.category", F.explode("p.levels").alias("level", "items"))
    each = of.select("no", "category", "level", F.posexplode("items").alias("item_no", "i"))
    return each.select("no", "category", "level", "item_no", "i.goal", F.coalesce("i.targets", F.array(F.lit("GLOBAL"))).alias("targets"), "i.primary_metric")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """The distinct categories of the policies, in order."""
    return policies(spark, path).select("category").where("category is not null").distinct().orderBy("category")


def read_test_data(spark: SparkSession, path: str) -> DataFrame:
    """Questions from CSV; question and ground_truth must be there, explanation becomes '' if it isn't."""
    out = spark.read.options(**_CSV).csv(path)
    missing = [c for c in ("question", "ground_truth") if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out if "explanation" in out.columns else out.withColumn("explanation", F.lit(""))


def read_retrieval_data(spark: SparkSession, path: str, names: tuple[str, ...] = ("ground_truth_filename", "source_files", "filename")) -> DataFrame:
    """(question, truth, ...) from CSV: truth is the first of names that is there."""
    out = spark.read.options(**_CSV).csv(path)
    found = next((n for n in names if n in out.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return out.withColumnRenamed(found, "truth")


def read_splits(spark: SparkSession, *paths: str) -> DataFrame:
    """Items of many dataset files with their split; each file is a list, or an object of train, validation and test."""
    item = f"struct<{', '.join(': '.join(c.strip().split(' ', 1)) for c in ITEM.split(','))}>"
    text = spark.read.text(list(paths), wholetext=True)
    none = F.array().cast(f"array<{item}>")
    parsed = text.select(F.ltrim(F.regexp_replace("value", "^﻿?\\s+", "")).alias("t"))
    flat = F.when(F.col("t").startswith("["), F.from_json("t", f"array<{item}>"))
    split = F.when(F.col("t").startswith("{"), F.from_json("t", f"struct<{', '.join(f'{s}: array<{item}>' for s in SPLITS)}>"))
    tagged = lambda rows, name: F.transform(F.coalesce(rows, none), lambda r: F.struct(F.lit(name).cast("string").alias("split"), r.alias("r")))
    rows = parsed.select(flat.alias("flat"), split.alias("by"))
    return rows.select(F.explode(F.concat(tagged(F.col("flat"), None), *[tagged(F.col(f"by.{s}"), s) for s in SPLITS])).alias("x")).select("x.split", "x.r.*")


def read_nested_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, gold_answer, context) of data[].paragraphs[].qas[]; the first answer counts, blank ones drop the question."""
    qa = "array<struct<question: string, answers: array<struct<text: string>>>>"
    raw = spark.read.schema(f"data array<struct<paragraphs: array<struct<context: string, qas: {qa}>>>>").json(path, multiLine=True)
    each = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q"))
    out = each.select(F.coalesce("q.question", F.lit("")).alias("question"), F.get("q.answers", F.lit(0))["text"].alias("gold_answer"), F.coalesce("context", F.lit("")).alias("context"))
    return out.where("trim(gold_answer) <> ''")


def read_model_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, text) from JSON lines; text is that of the first choice, '' if there is none. Lines that aren't JSON are left out."""
    body = "response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"
    raw = spark.read.schema(f"custom_id string, text string, {body}").json(path)
    first = F.get("response.body.choices", F.lit(0))["message"]["content"]
    return raw.where("custom_id is not null").select("custom_id", F.coalesce("text", first, F.lit("")).alias("text"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, host, port, device_type) of devices[] in JSON: oob_ip and telnet_port, else host or ip and port. Passwords aren't in the schema, so they are never read."""
    raw = spark.read.schema("devices array<struct<name: string, oob_ip: string, telnet_port: int, host: string, ip: string, port: int, device_type: string>>").json(path, multiLine=True)
    return raw.select(F.explode("devices").alias("d")).select("d.name", F.coalesce("d.oob_ip", "d.host", "d.ip").alias("host"), F.coalesce("d.telnet_port", "d.port").alias("port"), "d.device_type")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.xml", recursive: bool = True) -> DataFrame:
    """(file, size, text) of the files under path: UTF-8 if they are valid in it, else Latin-1, which takes any bytes."""
    raw = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=recursive).load(path)
    tried = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.regexp_replace(tried, "^﻿", "").alias("text"))


def write_dataset(items: DataFrame, path: str) -> None:
    """JSON lines, a folder for each split."""
    items.write.partitionBy("split").json(path)


def csv_rows(items: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """The columns of a CSV form as text: lists of files joined, other lists and maps as JSON, absent columns empty."""

    def told(name: str) -> Column:
        if name not in items.columns:
            return F.lit("").alias(name)
        kind = items.schema[name].dataType.typeName()
        if name == "source_files" and kind == "array":
            return F.array_join(F.coalesce(name, F.array().cast("array<string>")), ", ").alias(name)
        return (F.to_json(name) if kind in ("array", "map", "struct") else F.col(name).cast("string")).alias(name)

    return items.select(*[told(c) for c in columns])


def write_csv(items: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    csv_rows(items, columns).write.options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_texts(texts: DataFrame, path: str, folders: list[str], text: str = "text", order: list[str] | None = None) -> None:
    """A text file or more in a folder for each value of folders, as device=x/section=y; texts of one folder are together, in order."""
    spread = texts.repartition(*folders).sortWithinPartitions(*folders, *(order or []))
    spread.select(*folders, F.coalesce(text, F.lit("")).alias("text")).write.partitionBy(*folders).text(path)


def write_report(report: DataFrame, path: str, **metadata: str) -> None:
    """A report's rows as JSON lines, each with the metadata it was made under; reports are a row for each group, so one file holds them."""
    told = F.struct(*[F.lit(str(v)).alias(k) for k, v in sorted(metadata.items())]) if metadata else F.lit(None)
    report.withColumn("metadata", told).coalesce(1).write.json(path)
