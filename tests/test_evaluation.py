"""Scores and reports against plain Python."""

import random

from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.operators import evaluation


def table_length(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in range(2))
        assert scores.common_subsequence(a, b) == table_length(a, b)


def test_scores(spark):
    rows = [
        ("Yes", " TRUE\n"), ("a, b,,b", "b , a"), ("größe drei", "Größe vier"), ("", ""), ("x", ""), (None, None), ("on, off", "yes"), ("a;b", "b; a"), ("a b", "b a"), ("the cat sat", "the cat ran"),
    ]
    p, t = F.col("p"), F.col("t")
    df = spark.createDataFrame(rows, "p string, t string")
    got = df.select(
        scores.exact_match(p, t), scores.relaxed_match(p, t), scores.token_f1(p, t), scores.relaxed_f1(p, t), scores.list_match(p, t), scores.list_f1(p, t), F.round(scores.rouge_n(p, t, 2), 3), F.round(scores.rouge_l("p", "t"), 3), scores.exact_match(p, t, False)
    ).collect()
    got = [tuple(r) for r in got]
    assert got[0][:4] == (1, 1, 1.0, 1.0) and got[0][8] == 0
    assert got[1][:2] == (0, 1) and got[1][3] == 1.0 and got[1][4:6] == (1, 1.0)
    assert got[2][2] == 0.5 and got[3] == (1, 1, 1.0, 1.0, 1, 0.0, 0.0, 0.0, 1) and got[4][:4] == (0, 0, 0.0, 0.0) and got[5] == got[3]
    assert round(got[6][3], 6) == round(2 / 3, 6) and got[7][4:6] == (1, 1.0) and got[8][4] == 0 and got[8][5] == 1.0
    assert got[9][6] == 0.5 and got[9][7] == 0.667


def test_retrieval(spark):
    rows = [(["b.xml", " a.xml", "c.xml"], "a.xml, z.xml"), (["b.xml"], ""), (None, "a.xml"), (["q", None], "q")]
    found = spark.createDataFrame(rows, "files array<string>, truth string")
    got = {r.k: (r.n, r.recall, r.mrr) for r in evaluation.retrieval_report(found, (1, 2)).collect()}
    assert got == {1: (4, 0.25, 0.375), 2: (4, 0.5, 0.375)}
    cited = spark.createDataFrame([(["A.xml "], ["a.xml"]), (["doc_2"], ["x", "y"]), (["#3"], ["x", "y"]), (["", None], ["x"]), (None, None), (["99999999999999"], ["x"])], "c array<string>, f array<string>")
    assert [r[0] for r in cited.select(scores.support_at_k(F.col("c"), F.col("f"))).collect()] == [True, True, False, False, False, False]


def test_reports(spark):
    answers = spark.createDataFrame([("rule_based", "yes", "true"), (None, "x y", "x z"), ("rule_based", "a", "b")], "origin string, prediction string, truth string")
    got = {r.origin: (r.n, r.em, r.f1) for r in evaluation.report(answers).collect()}
    assert got == {"rule_based": (2, 0.5, 0.5), "general": (1, 0.0, 0.5), "overall": (3, 1 / 3, 0.5)}
    assert evaluation.report(answers.limit(0)).isEmpty()
    told = evaluation.predictions_with_sections(spark.createDataFrame([("[GROUND_TRUTH] 5 [EXPLANATION] as a b", "as a c"), (None, " ")], "answer string, explanation string"))
    one = evaluation.explanation_report(told).first()
    assert (one.n_valid, one.n, round(one.rouge_1, 3), one.rouge_2, round(one.rouge_l, 3)) == (1, 2, 0.667, 0.5, 0.667)
    out = evaluation.with_model_outputs(spark.createDataFrame([("q1",), ("q2",)], "custom_id string"), {"m": spark.createDataFrame([("q1", "b"), ("q1", "a"), ("q9", "c")], "custom_id string, text string")})
    assert sorted(map(tuple, out.collect())) == [("q1", "a"), ("q2", "")]
    a = spark.createDataFrame([(1, "x", "y"), (2, "y", "y")], "qid int, prediction string, truth string")
    b = spark.createDataFrame([(1, "y", "y"), (2, "z", "y")], "qid int, prediction string, truth string")
    assert {r.qid: r.change for r in evaluation.before_after(a, b).collect()} == {1: "better", 2: "worse"}


def test_ngrams_of_long_texts_take_time_that_grows_with_their_length(spark):
    import time

    text = " ".join(f"w{i}" for i in range(20_000))
    start = time.perf_counter()
    rows = spark.createDataFrame([(text, text + " more"), ("a b", "a"), (None, None), ("a b a b", "b a")], "p string, t string")
    got = [tuple(r) for r in rows.select(scores.rouge_n(F.col("p"), F.col("t"), 1), scores.rouge_n(F.col("p"), F.col("t"), 2)).collect()]
    assert got == [(40_000 / 40_001, 39_998 / 39_999), (2 / 3, 0.0), (0.0, 0.0), (1.0, 2 / 3)]
    assert time.perf_counter() - start < 20
