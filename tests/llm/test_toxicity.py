"""Toxicity: held-out accuracy, and features of odd texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import queries, toxicity


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdefghiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 5) * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["grumbel", "GRUMBEL!!", "snarfo", "snarfolation", "y0u snarfo"]))
        yield i, " ".join(text), int(toxic)


def test_held_out_accuracy(spark):
    rows = list(made(900))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(None, None, None, None), (901, "", "x", 0.0), (901, "", "x", 0.0)], "doc_id long, text string, f0 string, probability double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = list(made(300, 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score(docs, labels).collect()) == sorted(toxicity.score(docs, turned).collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_features_of_odd_texts():
    lexicon = {"grumbel": 3.0, "snar|": 2.0}
    f = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(["", "   ", "you GRUMBEL!! snarfs a b", "gr-umb3l soooo", "x" * 100000]), lexicon).T))
    assert f["word_hits"].tolist() == [0, 0, 0.2, 0, 0] and f["stem_hits"][2] == 0.2
    assert f["hits_near_you"][2] == 1 and np.isclose(f["distinct_hits"][2], np.log(3)) and f["strongest_hit"][2] == 3.0
    assert f["hidden_hits"][3] == 0.5 and f["stretched_words"][3] == 0.5 and f["shouted_words"][2] == 0.2


def test_query_over_whole_table(spark):
    rows = queries.op6_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
