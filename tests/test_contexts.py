"""Contexts, flattened documents and device texts on small made inputs."""

import json

from pyspark.sql import functions as F

from factloom.functions import configs
from factloom.operators import contexts


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_texts(spark):
    assert one(spark, configs.normal_path, "//a///b/", "", None) == ["a/b", "", None]
    assert one(spark, configs.traceroute_path, "1 9.9.9.9 2 ms\n2 8.8.8.8 3 9.9.9.9", "none", None) == [["9.9.9.9", "8.8.8.8"], [], []]
    assert one(spark, configs.ping_loss, "Success rate is 80 percent (4/5)", "5 packets transmitted, 5 received", "nothing", "(0/0)", None) == [20.0, 0.0, 100.0, 100.0, 100.0]
    raw = "admin@ncs# show\n\nresult \n! begin\nhostname r1\nr1#\nend"
    assert one(spark, configs.clean_config, raw, "no lines of one", None) == ["! begin\nhostname r1\nend", "", None]
    assert one(spark, configs.metric_of_id, "BGP_PEERS_0001", "x") == ["BGP_PEERS", ""]
    assert one(spark, configs.json_in, 'so:\n```json\n{"a": 1}\n```', 'it is [1, 2] here', "none {", None) == ['{"a": 1}', "[1, 2]", None, None]
    df = spark.createDataFrame([("Admin-Password", "x"), ("name", "y"), (None, "z")], "k string, v string")
    assert [r[0] for r in df.select(configs.masked(F.col("k"), F.col("v"))).collect()] == ["***", "y", "z"]
    lists = spark.createDataFrame([(list("abcde"),), (list("ab"),)], "l array<string>")
    assert [r[0] for r in lists.select(configs.first_three(F.col("l"))).collect()] == ["a, b, c ... (5 in all)", "a, b"]


def test_flattened(spark):
    xml = '<d xmlns="urn:x"><sys><name>r1</name><secret>s3</secret></sys><if><name>e0</name><mtu>9</mtu></if><if><mtu>8</mtu></if></d>'
    leaves = contexts.flattened(spark.createDataFrame([("a", xml), ("b", "<open>"), ("c", None)], "file string, text string"))
    rows = {(r.file, r.no): (r.path, r.value) for r in leaves.collect()}
    assert [rows["a", i] for i in range(5)] == [("sys/name", "r1"), ("sys/secret", "***"), ("if[e0]/name", "e0"), ("if[e0]/mtu", "9"), ("if[2]/mtu", "8")] and rows["b", 0][0] == ""
    told = {(r.file, r.section): r.text for r in contexts.section_texts(leaves.where("file = 'a'")).collect()}
    assert told["a", "sys"] == "sys/name: r1\nsys/secret: ***" and told["a", "if[2]"] == "if[2]/mtu: 8"


def test_rerank(spark):
    found = spark.createDataFrame([(q, r, f"{q}{r}") for q in "xyz" for r in (1, 2, 3)], "qid string, rank int, doc_id string")
    said = spark.createDataFrame([("x", "Doc[3], doc[9], Doc[1] and Doc[3]"), ("y", "none"), ("y", None)], "qid string, text string")
    got = {}
    for r in sorted(contexts.reranked(found, said, 2).collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append(r.doc_id)
    assert got == {"x": ["x3", "x1"], "y": ["y1", "y2"], "z": ["z1", "z2"]}
    line = json.loads(contexts.batch_requests(spark.createDataFrame([(7, 'say "a"')], "qid int, question string"), "m").first().value)
    assert line["custom_id"] == "7" and line["body"]["messages"][0]["content"] == 'say "a"'
