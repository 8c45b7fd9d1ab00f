"""Plain and raw answers, pieces of equal length, replies to pings, and texts in folders."""

import json
import time

from pyspark.sql import functions as F

from factloom.functions import configs
from factloom.functions import text as T
from factloom.operators import contexts
from factloom.sources import datasets


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_plain_and_raw(spark):
    assert values(spark, [('{"a": 1, "b": null}',), ('["x", null, 2]',), ('"s"',), ("7",), ("null",), ("not json",), (None,), ("",)], "j string", T.plain_text(F.col("j"))) == ["a: 1, b: ", "x, , 2", "s", "7", "", "not json", "", ""]
    rows = [("set", "a, b"), ("map", "k=v, m=x=y"), ("numeric", "5"), ("numeric", "x"), ("boolean", "True"), ("text", 'say "hi"'), ("set", ""), ("text", None)]
    assert [json.loads(x) for x in values(spark, rows, "t string, a string", T.raw_answer(F.col("t"), F.col("a")))] == [["a", "b"], {"k": "v", "m": "x=y"}, 5, "x", True, 'say "hi"', [], None]


def test_equal_chunks(spark):
    texts = ["", "abc", "x" * 10, "é日" * 7, "y" * 1000]
    for text, got in zip(texts, values(spark, [(t,) for t in texts], "t string", T.equal_chunks(F.col("t"), 4))):
        pieces = [c.text for c in got]
        assert "".join(pieces) == text and len(pieces) == len(text) // 4 + 1
        assert max(map(len, pieces)) - min(map(len, pieces)) <= 1 and [c.chunk for c in got] == list(range(len(pieces)))


def test_ping_stats(spark):
    rows = [("Success rate is 80 percent (4/5), round-trip min/avg/max = 1/2/40 ms",), ("5 packets transmitted, 0 received, 100% packet loss",), ("no reply",), (None,)]
    got = values(spark, rows, "t string", configs.ping_stats(F.col("t")))
    assert [tuple(r) for r in got] == [(4, 5, 20.0, 1, 2, 40), (0, 5, 100.0, None, None, None), (None, None, 100.0, None, None, None), (None, None, 100.0, None, None, None)]


def test_texts_by_folder_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "bgp", 2, "second"), ("r1", "bgp", 1, "first"), ("r2", "ospf", 1, None)], "device string, section string, no int, text string")
    datasets.write_texts(rows, str(tmp_path / "t"), ["device", "section"], order=["no"])
    files = {f.parent.relative_to(tmp_path / "t").as_posix(): f.read_text() for f in (tmp_path / "t").rglob("*.txt")}
    assert files == {"device=r1/section=bgp": "first\nsecond\n", "device=r2/section=ospf": "\n"}
    datasets.write_report(rows.groupBy("device").count(), str(tmp_path / "r"), seed=42, k=5)
    lines = [json.loads(x) for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["device"] for x in lines} == {"r1", "r2"} and all(x["metadata"] == {"k": "5", "seed": "42"} for x in lines)


def test_clean_xml(spark):
    raw = ["admin@ncs# show x\nshow running\n\n<config>\n  admin@ncs% \n  <a/>\n  show y\n</config>", "nothing", None, "  <a>\r\n b"]
    assert values(spark, [(t,) for t in raw], "t string", configs.clean_xml(F.col("t"))) == ["<config>\n  <a/>\n</config>", "", None, "  <a>\n b"]


def test_section_documents(spark):
    xml = "<c><router><id>1</id></router><zeta><q>9</q></zeta><interface><Loopback><name>0</name></Loopback><Ethernet><name>1</name><password>p</password></Ethernet><Ethernet><name>2</name></Ethernet></interface><hostname>h</hostname></c>"
    leaves = contexts.flattened(spark.createDataFrame([("a.xml", xml), ("b.xml", "<c><version>7</version></c>")], "file string, text string"))
    # the paths begin below the root element
    first = leaves.withColumn("path", F.regexp_replace("path", r"^c/", ""))
    got = contexts.section_documents(first, spark.createDataFrame([("a.xml", "edge")], "file string, device_name string")).orderBy("file", "place").collect()
    own = [r for r in got if r.file == "a.xml"]
    assert own[0].section == "hostname" and own[1].section == "router" and own[-1].section == "zeta" and [r.place for r in own] == list(range(len(own)))
    assert sum(r.section.startswith("interface_") for r in own) == 3 and not any("password: p" in r.text for r in own)
    assert own[1].text == "[METADATA]\nsection: router\ndevice_name: edge\nsource: a.xml\n\n[CONTENT]\n[SECTION] router\nrouter/id: 1\n"
    assert [r.text.split("\n")[2] for r in got if r.file == "b.xml"] == ["device_name: b.xml"]


def test_long_texts_are_cut_in_time_that_grows_with_their_length(spark):
    text = ("añ😀\n" * 100_000)[:-1]
    start = time.perf_counter()
    got = values(spark, [(text,)], "t string", T.equal_chunks(F.col("t"), 10))[0]
    assert [p["chunk"] for p in got] == list(range(len(text) // 10 + 1)) and "".join(p["text"] for p in got) == text and {len(p["text"]) for p in got} == {9, 10}
    assert time.perf_counter() - start < 20
