"""Queries of question generators over traces, stratified samples, quotas and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import generators, sampling
from factloom.plans.traces import derived, with_tables
from factloom.registry import query, table
from factloom.trace_queries import _FIRST, _OK

#: Hashes of samples are Spark's, which SQL elsewhere doesn't have: these generators are asked for all their questions, by id, so both sides can be compared.
_WHOLE = tuple(g for g in generators.L4 + generators.L5 if g.name in ("traceroute_path", "bounded_path_length", "k_failure_tolerance", "path_asymmetry", "link_failure_impact"))
_UNCAPPED = tuple(generators.Generator(g.name, g.level, g.category, g.answer_type, g.pattern, g.rows) for g in _WHOLE)
_NAME = {g.name: g for g in _WHOLE}


def _told(name: str, stratum: str, parts: list[str], truth: str, relation: str) -> str:
    g = _NAME[name]
    said = f"'{g.pattern}'"
    for i, c in enumerate(parts):
        said = f"replace({said}, '{{{{{i}}}}}', CAST({c} AS VARCHAR))".replace("{{", "{").replace("}}", "}")
    scope = " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in parts)
    return f"SELECT '{name}' AS generator, '{g.level}' AS level, CAST({stratum} AS VARCHAR) AS stratum, {scope} AS scope, {said} AS question, {truth} AS ground_truth FROM ({relation})"


_ALL = " UNION ALL ".join((
    _told("traceroute_path", "src", ["flow_id", "src", "dst", "dst_ip"], f"array_to_string(path, ' {generators.ARROW} ')", "SELECT * FROM q JOIN flows USING (flow_id) WHERE len(path) > 0"),
    _told("bounded_path_length", "src", ["flow_id", "src", "dst"], "CAST(n_hops AS VARCHAR)", "SELECT * FROM q JOIN flows USING (flow_id)"),
    _told("k_failure_tolerance", "src", ["flow_id", "src", "dst"], "CAST(n > 1 AS VARCHAR) || ' (' || n || ')'", "SELECT * FROM (SELECT flow_id, count(DISTINCT path) AS n FROM p WHERE accepted GROUP BY 1) JOIN flows USING (flow_id)"),
    _told("path_asymmetry", "a", ["a", "b"], "CAST(same AS VARCHAR)", "SELECT x.src AS a, x.dst AS b, x.path = list_reverse(y.path) AS same FROM ff x JOIN ff y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst"),
    _told("link_failure_impact", "a || '-' || b", ["a", "b", "flow_id"], "CASE WHEN used < n THEN 'reroute' ELSE 'outage' END", "SELECT * FROM used JOIN nt USING (flow_id) JOIN flows USING (flow_id) WHERE src NOT IN (a, b) AND dst NOT IN (a, b)"),
))


@query(with_tables("flows", "traces") + _FIRST + f""", ff AS (SELECT src, dst, path FROM (SELECT src, dst, min(flow_id) AS flow_id FROM flows WHERE src <> dst GROUP BY 1, 2) JOIN q USING (flow_id)),
steps AS (SELECT flow_id, trace_no, node, lead(node) OVER (PARTITION BY flow_id, trace_no ORDER BY hop_no, node) AS next FROM traces WHERE node IS NOT NULL),
used AS (SELECT flow_id, a, b, count(*) AS used FROM (SELECT DISTINCT flow_id, trace_no, least(node, next) AS a, greatest(node, next) AS b FROM steps WHERE node <> next) GROUP BY 1, 2, 3),
nt AS (SELECT flow_id, count(DISTINCT trace_no) AS n FROM traces GROUP BY 1) {_ALL}""")
def generated_questions(spark, sf):
    """All questions of five generators, none left out."""
    found = generators.questions(derived(spark, sf, "flows"), derived(spark, sf, "traces"), _UNCAPPED)
    return found.select("generator", "level", "stratum", "scope", "question", "ground_truth")


@query("")
def sampled_questions(spark, sf):
    """Both levels with their caps: which rows a seed takes follows from Spark's hash, so tests hold it against plain sorting."""
    return generators.questions(derived(spark, sf, "flows"), derived(spark, sf, "traces"))


#: What each part type could give, and half of all parts to be dealt.
_SUPPLY = "SELECT p_brand AS category, p_type AS template, count(*) AS supply FROM part GROUP BY 1, 2"


@query(f"""WITH RECURSIVE s AS ({_SUPPLY}), t AS (SELECT category, CAST(30 AS BIGINT) AS total FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY supply, template) AS place, count(*) OVER (PARTITION BY category) AS n FROM s),
levels AS (SELECT category, l, sum(least(supply, l)) AS used FROM s, generate_series(0, 30) g(l) GROUP BY 1, 2),
even AS (SELECT category, max(l) AS l FROM levels JOIN t USING (category) WHERE used <= total GROUP BY 1),
base AS (SELECT r.*, l, least(supply, l) AS got FROM r JOIN even USING (category)),
rest AS (SELECT category, any_value(total) - sum(got) AS rest, count(*) FILTER (supply > l) AS open FROM base JOIN t USING (category) GROUP BY 1)
SELECT category, template, CAST(got + CASE WHEN supply > l AND row_number() OVER (PARTITION BY category ORDER BY CASE WHEN supply > l THEN 0 ELSE 1 END, supply DESC, template DESC) <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM base JOIN rest USING (category)""")
def question_quotas(spark, sf):
    supplies = table(spark, sf, "part").groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("template")).agg(F.count("*").alias("supply"))
    return sampling.quotas(supplies, "template", 30, by=["category"])


@query("WITH n AS (SELECT c_mktsegment AS category, count(*) FILTER (c_custkey % 3 = 0) AS have, count(*) FILTER (c_custkey % 3 > 0) AS pool FROM customer GROUP BY 1) SELECT category, CAST(have + least(pool, greatest(0, 250 - have)) AS BIGINT) AS n, least(pool, greatest(0, 250 - have)) AS added FROM n")
def coverage_fill(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"), "c_custkey")
    have, pool = c.where("c_custkey % 3 = 0"), c.where("c_custkey % 3 > 0")
    budget = c.select("category").distinct().withColumn("n", F.lit(250))
    out = sampling.filled(have, pool, budget, "category", ["c_custkey"])
    return out.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") % 3 > 0).alias("added"))
