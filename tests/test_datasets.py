"""Dataset files and operators on small made inputs."""

import json

from pyspark.sql import functions as F

from factloom.operators import datasets, relations
from factloom.sources import datasets as files


def test_numbered(spark):
    rows = [("hot", i % 700) for i in range(1000)] + [("b", 5), ("b", None), (None, 1), (None, 2)]
    got = relations.numbered(spark.createDataFrame(rows, "k string, v int").repartition(7), "k", ["v"]).collect()
    for key in ("hot", "b", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}
        assert [r.v for r in own] == sorted((r.v for r in own), key=lambda v: (v is not None, v or 0))
    assert relations.numbered(spark.createDataFrame([], "k string, v int"), "k", ["v"]).isEmpty()


def test_filled_and_hints(spark):
    df = spark.createDataFrame([("{a} and {b}", "x", "y"), ("{a} and {c}", "x", "y"), ("{a}", None, None), ("none", "x", "y")], "p string, a string, b string")
    got = [r[0] for r in df.select(datasets.filled(F.col("p"), {"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == ["x and y", "{a} and {c}", "{a}", "none"]
    q = spark.createDataFrame([("how many?", "numeric"), ("a whole number, how many?", "numeric"), ("q", "number"), ("q", None)], "q string, t string")
    assert [r[0] for r in q.select(datasets.with_hint(F.col("q"), F.col("t"))).collect()] == ["how many?\n[Answer format] a whole number", "a whole number, how many?", "q", "q"]


def test_sampled(spark):
    hosts = spark.createDataFrame([(f"h{i}",) for i in range(10)], "scope string")
    one, two = (sorted(r.scope for r in datasets.sampled(hosts.repartition(n), 0.3).collect()) for n in (1, 5))
    assert one == two and len(one) == 3 and datasets.sampled(hosts.limit(1), 0.3).count() == 1


def test_policies(spark, tmp_path):
    item = lambda goal, **more: {"goal": goal, **more}
    text = {"policies": [
        {"category": "Security", "levels": {"L1": [item("g1", targets=["DEVICE", "PLANET"], primary_metric="m3")], "L2": [item("g2"), item("unknown")]}},
        {"category": "Access", "levels": {"L1": [item("g1", targets=["DEVICE"])]}}, {"category": "Empty"},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(text))
    pol = files.policies(spark, str(tmp_path / "p.json"))
    assert pol.count() == 4 and [r.category for r in files.categories(spark, str(tmp_path / "p.json")).collect()] == ["Access", "Security"]
    goals = spark.createDataFrame([("Security", "g1", 0, "m1"), ("Security", "g1", 1, "m3"), ("Security", "g2", 0, "m1"), ("Security", "g2", 1, "m9")], "category string, goal string, place int, metric string")
    allowed = spark.createDataFrame([("Security", "m1"), ("Security", "m3")], "category string, metric string")
    patterns = spark.createDataFrame([("m1", "What of {host}?", "text"), ("m3", "How many?", "numeric")], "metric string, pattern string, answer_type string")
    scopes = spark.createDataFrame([("DEVICE", "DEVICE")], "target string, scope_type string")
    got = {(r.metric, r.scope_type): (r.level, r.goal, r.pattern) for r in datasets.compile_templates(pol, goals, allowed, patterns, scopes, "[x] ").collect()}
    assert got == {("m3", "DEVICE"): ("L1", "g1", "[x] How many?"), ("m3", "GLOBAL"): ("L1", "g1", "[x] How many?"), ("m1", "DEVICE"): ("L1", "g1", "[x] What of {host}?"), ("m1", "GLOBAL"): ("L1", "g1", "[x] What of {host}?")}


def test_files(spark, tmp_path):
    at = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    items = lambda *ids: [{"id": i, "question": "q?", "source_files": ["b.xml", "a.xml"]} for i in ids]
    split, flat = at("s.json", json.dumps({"train": items("1", "2"), "test": items("3")}, indent=1)), at("f.json", "\n" + json.dumps(items("4")))
    rows = files.read_splits(spark, split, flat)
    assert sorted((r.id, r.split) for r in rows.collect()) == [("1", "train"), ("2", "train"), ("3", "test"), ("4", None)]
    files.write_csv(rows.withColumn("question", F.lit('say "a",\nthen b')), str(tmp_path / "csv"))
    back = files.read_test_data(spark, str(tmp_path / "csv"))
    assert back.columns == list(files.CSV_COLUMNS) and {(r.question, r.source_files) for r in back.collect()} == {('say "a",\nthen b', "b.xml, a.xml")}
    files.write_dataset(rows.na.fill("train", ["split"]), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).groupBy("split").count().count() == 2
    qa = at("qa.json", json.dumps({"data": [{"paragraphs": [{"context": "c", "qas": [{"question": "a", "answers": [{"text": "1"}, {"text": "2"}]}, {"question": "b", "answers": [{"text": " "}]}, {"question": "d", "answers": []}]}]}]}))
    assert [tuple(r) for r in files.read_nested_questions(spark, qa).collect()] == [("a", "1", "c")]
    lines = at("o.jsonl", json.dumps({"custom_id": "x", "response": {"body": {"choices": [{"message": {"content": "hi"}}]}}}) + "\nnot json\n" + json.dumps({"custom_id": "y"}) + "\n")
    assert sorted(tuple(r) for r in files.read_model_outputs(spark, lines).collect()) == [("x", "hi"), ("y", "")]
    inv = at("i.json", json.dumps({"devices": [{"name": "r1", "ip": "9.9.9.9", "password": "s"}]}))
    assert [(r.name, r.host) for r in files.read_inventory(spark, inv).collect()] == [("r1", "9.9.9.9")]
    bare = at("bare.csv", "question,source_files\nq,a.xml\n")
    assert files.read_retrieval_data(spark, bare).first().truth == "a.xml"
    try:
        files.read_test_data(spark, bare)
        raise AssertionError("a missing column must be told")
    except ValueError as e:
        assert "ground_truth" in str(e)


def test_texts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xml").write_bytes(b"\xef\xbb\xbf<a>\xc3\xa9</a>")
    (tmp_path / "deep" / "b.xml").write_bytes(b"<a>\xe9</a>")
    (tmp_path / "c.txt").write_bytes(b"no")
    assert sorted((r.file, r.size, r.text) for r in files.read_texts(spark, str(tmp_path)).collect()) == [("a.xml", 12, "<a>é</a>"), ("b.xml", 8, "<a>é</a>")]
