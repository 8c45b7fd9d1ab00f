"""Reports of predictions against truths, over all and by origin, and of retrieval at several depths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.functions.text import sections


def predictions_with_sections(answers: DataFrame) -> DataFrame:
    """answers with prediction and predicted_explanation, the two sections of the column answer."""
    return answers.withColumn("_s", sections(F.coalesce("answer", F.lit("")))).withColumn("prediction", F.col("_s.truth")).withColumn("predicted_explanation", F.col("_s.explanation")).drop("_s")


def scored(answers: DataFrame, booleans: bool = True) -> DataFrame:
    """answers(prediction, truth, ...) with em, f1, em_relaxed and f1_relaxed."""
    p, t = F.col("prediction"), F.col("truth")
    return answers.withColumns({
        "em": scores.exact_match(p, t, booleans), "f1": scores.token_f1(p, t, booleans), "em_relaxed": scores.relaxed_match(p, t), "f1_relaxed": scores.relaxed_f1(p, t),
    })


def report(answers: DataFrame) -> DataFrame:
    """(origin, n, em, f1, em_relaxed, f1_relaxed): means by origin, and of all rows as 'overall'.

    A null origin is 'general'. One pass: partial sums by origin alone are shuffled. An empty table gives no rows.
    """
    rows = scored(answers.withColumn("origin", F.coalesce("origin", F.lit("general"))))
    means = [F.avg(c).alias(c) for c in ("em", "f1", "em_relaxed", "f1_relaxed")]
    out = rows.rollup("origin").agg(F.grouping("origin").alias("all"), F.count("*").alias("n"), *means).where("n > 0")
    return out.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("origin")).alias("origin"), "n", "em", "f1", "em_relaxed", "f1_relaxed")


def explanation_report(answers: DataFrame) -> DataFrame:
    """(n_valid, n, rouge_1, rouge_2, rouge_l) of answers(explanation, predicted_explanation); blank explanations aren't valid."""
    p, t = F.col("predicted_explanation"), F.col("explanation")
    valid = F.coalesce(F.trim(t) != "", F.lit(False))
    rows = answers.select(valid.alias("valid"), scores.rouge_n(p, t, 1).alias("r1"), scores.rouge_n(p, t, 2).alias("r2"), scores.rouge_l(p, t).alias("rl"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("valid"), F.col(c))), F.lit(0.0))
    return rows.agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n"), mean("r1").alias("rouge_1"), mean("r2").alias("rouge_2"), mean("rl").alias("rouge_l"))


def retrieval_report(found: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(k, n, recall, mrr) of found(files, truth): files in order of rank, truth a comma-separated list; one pass for all k."""
    rows = found.select(scores.reciprocal_rank(F.col("files"), F.col("truth")).alias("rr"), *[scores.recall_at(F.col("files"), F.col("truth"), k).alias(f"r{k}") for k in ks])
    one = rows.agg(F.count("*").alias("n"), F.avg("rr").alias("mrr"), *[F.avg(f"r{k}").alias(f"r{k}") for k in ks])
    lines = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])
    return one.select("n", "mrr", F.explode(lines).alias("x")).select("x.k", "n", "x.recall", "mrr")


def with_model_outputs(questions: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """questions(custom_id, ...) with a column for each named output(custom_id, text); '' where it has none, the least text of several."""
    for name, rows in outputs.items():
        one = rows.groupBy("custom_id").agg(F.min("text").alias(name))
        questions = questions.join(one, "custom_id", "left").na.fill("", [name])
    return questions


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, truth, before, after, em_before, em_after, change) of two tables(qid, prediction, truth), one row for each qid."""
    a = scored(before).select("qid", "truth", F.col("prediction").alias("before"), F.col("em").alias("em_before"))
    b = scored(after).select("qid", F.col("prediction").alias("after"), F.col("em").alias("em_after"))
    change = F.when(F.col("em_after") > F.col("em_before"), "better").when(F.col("em_after") < F.col("em_before"), "worse").otherwise("same")
    return a.join(b, "qid").select("qid", "truth", "before", "after", "em_before", "em_after", change.alias("change"))
