"""Nodes of JSON trees against a plain walk."""

import json

from factloom.operators import trees

TEXTS = ['{"a:x": {"b:y": [1, "two", null, {"c:z:w": true}], "y": {}}, "n:x": 5}', "[]", "7", '"s"', "null", "not json", None, "", '{"k": {"p:q": [[1.5], []]}}', '[{"a": 1}, {"a": 2}]']


def walk(value, path, depth, clean, out):
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "scalar"
    out.append((path, depth, kind, None if kind != "scalar" else value if isinstance(value, str) else json.dumps(value)))
    if kind == "object":
        last = {}
        for k in sorted(value):
            last[k.split(":")[-1] if clean else k] = value[k]
        for k, v in last.items():
            walk(v, f"{path}.{k}", depth + 1, clean, out)
    if kind == "array":
        for i, v in enumerate(value):
            walk(v, f"{path}[{i}]", depth + 1, clean, out)


def test_nodes_match_a_walk(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0])], "id long, json string")
    for clean in (True, False):
        want = []
        for i, t in [*enumerate(TEXTS), (0, TEXTS[0])]:
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                continue
            out = []
            walk(value, "$", 0, clean, out)
            want += [(i, *x) for x in out]
        got = sorted(map(tuple, trees.nodes(docs, ["id"], "json", clean).collect()), key=repr)
        assert got == sorted(want, key=repr)
    assert trees.nodes(docs.where("false"), ["id"], "json").collect() == []
    found = {(r.path, r.kind): r.n for r in trees.shapes(trees.nodes(docs, ["id"], "json")).collect()}
    assert found["$[*].a", "scalar"] == 2 and found["$", "object"] == 3
