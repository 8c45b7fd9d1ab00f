"""Question datasets: templates from policies, scopes, questions, answers with their files, ids and splits.

Templates, goals and scopes are small tables given by the user; answers are rows of factloom.operators.metrics. A null in
a key matches nothing; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import falsy
from factloom.operators.relations import numbered

#: How an answer of each type is to be written.
ANSWER_HINTS = {
    "boolean": "true/false (lower case)", "numeric": "a whole number", "set": "items separated by commas", "list": "items separated by commas", "map": "entries of the form key=value", "text": "a short text",
}


def compile_templates(policies: DataFrame, goals: DataFrame, allowed: DataFrame, patterns: DataFrame, scopes: DataFrame, prefix: str = "") -> DataFrame:
    """(category, level, goal, metric, scope_type, answer_type, pattern): one row for each metric of a policy's goal and target.

    policies as factloom.sources.datasets.policies gives them; goals(category, goal, place, metric); allowed(category,
    metric); patterns(metric, pattern, answer_type); scopes(target, scope_type). A primary metric comes before those of the
    goal. Unknown targets are GLOBAL. Of equal (category, metric, scope_type) the first in file order stays.
    """
    primary = policies.where("primary_metric is not null").select("*", F.lit(-1).alias("place"), F.col("primary_metric").alias("metric"))
    merged = primary.unionByName(policies.join(goals.select("category", "goal", "place", "metric"), ["category", "goal"]))
    rows = merged.join(allowed.select("category", "metric").distinct(), ["category", "metric"]).select("*", F.posexplode("targets").alias("target_no", "target"))
    rows = rows.join(scopes.select("target", "scope_type"), "target", "left").withColumn("scope_type", F.coalesce("scope_type", F.lit("GLOBAL"))).join(patterns, "metric")
    order = F.struct("no", "level", "item_no", "place", "target_no")
    kept = F.min_by(F.struct("level", "goal", "answer_type", "pattern"), order)
    out = rows.groupBy("category", "metric", "scope_type").agg(kept.alias("t"))
    return out.select("category", "t.level", "t.goal", "metric", "scope_type", "t.answer_type", F.trim(F.concat(F.lit(prefix), F.col("t.pattern"))).alias("pattern"))


def filled(pattern: Column, values: dict[str, Column]) -> Column:
    """The pattern with {key} replaced by values; as it was if one stays open. Null values leave theirs open."""
    out = pattern
    for key, value in values.items():
        out = F.replace(out, F.lit(f"{{{key}}}"), F.coalesce(value, F.lit(f"{{{key}}}")))
    return F.when(F.rlike(out, F.lit(r"\{\w+\}")), pattern).otherwise(out)


def sampled(hosts: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """max(1, n * ratio) of hosts(scope), the same ones for the same seed."""
    n = hosts.count()
    return hosts.orderBy(F.xxhash64("scope", F.lit(seed)), "scope").limit(max(1, int(n * ratio)))


def scopes_of(facts: dict[str, DataFrame]) -> DataFrame:
    """(scope_type, scope, keys): every scope of the facts; keys holds what its patterns can name."""
    d = facts["devices"]

    def rows(kind: str, df: DataFrame, **keys: str) -> DataFrame:
        named = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(c) for c in keys.values()])) if keys else F.create_map().cast("map<string,string>")
        return df.select(F.lit(kind).alias("scope_type"), F.concat_ws("/", *keys.values()).alias("scope") if keys else F.lit("GLOBAL").alias("scope"), named.alias("keys"))

    one = d.limit(1)
    ases = d.where(~falsy(F.col("local_as"))).select("local_as").distinct()
    vrfs = facts["vrfs"].select("vrf").where(~falsy(F.col("vrf"))).distinct()
    areas = facts["areas"].select("area").where(~falsy(F.col("area"))).distinct()
    bound = facts["interfaces"].where(~falsy(F.col("vrf"))).join(d.select("ord", "host"), "ord").select("host", "vrf").distinct()
    out = rows("GLOBAL", one).union(rows("DEVICE", d.select("host").distinct(), host="host")).union(rows("AS", ases, asn="local_as"))
    return out.union(rows("VRF", vrfs, vrf="vrf")).union(rows("OSPF_AREA", areas, area="area")).union(rows("DEVICE_VRF", bound, host="host", vrf="vrf"))


def scope_files(facts: dict[str, DataFrame]) -> DataFrame:
    """(scope_type, scope, files): the sorted files of a scope's devices; scopes that aren't here take all files."""
    d = facts["devices"].select("ord", "host", "file", "local_as").where(~falsy(F.col("file")))
    by = lambda kind, df, c: df.groupBy(c).agg(F.array_sort(F.collect_set("file")).alias("files")).select(F.lit(kind).alias("scope_type"), F.col(c).alias("scope"), "files")
    vrfs = facts["vrfs"].where(~falsy(F.col("vrf"))).join(d, "ord")
    bound = facts["interfaces"].where(~falsy(F.col("vrf"))).join(d, "ord").withColumn("both", F.concat_ws("/", "host", "vrf"))
    return by("DEVICE", d, "host").union(by("AS", d.where(~falsy(F.col("local_as"))), "local_as")).union(by("VRF", vrfs, "vrf")).union(by("DEVICE_VRF", bound, "both"))


def questions(templates: DataFrame, scopes: DataFrame, answers: DataFrame) -> DataFrame:
    """Templates times the scopes of their type, those that have an answer: (category, level, metric, scope_type, scope, answer_type, question, answer).

    answers(metric, scope, answer). Templates meet scopes by their type, then answers by metric and scope: no scope
    without an answer is carried further.
    """
    open_ = templates.join(answers, "metric").join(scopes, ["scope_type", "scope"])
    values = {k: F.try_element_at("keys", F.lit(k)) for k in ("host", "asn", "vrf", "area")}
    return open_.select("category", "level", "metric", "scope_type", "scope", "answer_type", filled(F.col("pattern"), values).alias("question"), "answer")


def explanation(metric: Column, scope: Column, answer: Column) -> Column:
    return F.concat(F.lit("metric `"), metric, F.lit("` on "), scope, F.lit(" → "), F.coalesce(answer, F.lit("")))


def with_hint(question: Column, answer_type: Column) -> Column:
    """The question with how to write its answer, unless it says so already; types without a hint add nothing."""
    hint = F.create_map(*[F.lit(x) for pair in ANSWER_HINTS.items() for x in pair])
    told = F.try_element_at(hint, answer_type)
    return F.when(told.isNull() | F.contains(question, told), question).otherwise(F.concat(question, F.lit("\n[Answer format] "), told))


def build(asked: DataFrame, files: DataFrame) -> DataFrame:
    """The dataset of questions(): ids by category, explanation, source files, and the split by place, 8:1:1, within a category.

    Rows with the same category, metric and question are one, the least scope's. Ids count in the order of metric and
    question. Null source files stand for all files: their list isn't repeated in every row.
    """
    first = F.min_by(F.struct("level", "scope_type", "scope", "answer_type", "answer"), F.struct("scope_type", "scope"))
    once = asked.groupBy("category", "metric", "question").agg(first.alias("r")).select("category", "metric", "question", "r.*")
    rows = numbered(once.join(files.withColumnRenamed("files", "source_files"), ["scope_type", "scope"], "left"), "category", ["metric", "question"])
    n80, n10 = F.floor(F.col("total") * F.lit(0.8)), F.floor(F.col("total") * F.lit(0.1))
    split = F.when(F.col("place") <= n80, "train").when(F.col("place") <= n80 + n10, "validation").otherwise("test")
    return rows.withColumns({
        "id": F.concat(F.upper("category"), F.lit("_"), F.lpad(F.col("place").cast("string"), 6, "0")), "split": split, "explanation": explanation(F.col("metric"), F.col("scope"), F.col("answer")),
        "ground_truth": F.coalesce("answer", F.lit("")), "question": with_hint(F.col("question"), F.col("answer_type")),
    }).drop("place", "total", "answer")
