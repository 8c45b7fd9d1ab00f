"""Queries of question datasets: templates from policies, scopes with answers, the built dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import datasets, metrics
from factloom.plans import facts, metric_sql
from factloom.registry import query
from factloom.sources.datasets import csv_rows

#: Templates by metric; one names a key that no scope has, so it stays as it is.
TEMPLATES = (
    ("System", "L1", "system_hostname_text", "DEVICE", "text", "What is the host name of {host}?"),
    ("System", "L1", "bgp_local_as_numeric", "DEVICE", "numeric", "Which AS number has {host}?"),
    ("Security", "L1", "ssh_present_bool", "DEVICE", "boolean", "Is SSH set up on {host}?"),
    ("Security", "L2", "ssh_missing_count", "GLOBAL", "numeric", "How many devices lack SSH?"),
    ("Security", "L2", "aaa_missing_devices", "GLOBAL", "set", "Which devices lack AAA?"),
    ("VPN", "L2", "devices_with_same_vrf", "VRF", "set", "Which devices have VRF {vrf}?"),
    ("VPN", "L3", "interfaces_in_vrf", "VRF", "number", "How many interfaces are in {vrf} at {site}?"),
    ("VPN", "L2", "vrf_interface_bind_count", "DEVICE_VRF", "numeric", "How many interfaces of {host} are in VRF {vrf}?"),
    ("Routing", "L2", "devices_in_as", "AS", "set", "Which devices are in AS {asn}?"),
    ("Routing", "L2", "ospf_area_membership", "OSPF_AREA", "set", "Which devices are in area {area}?"),
)
_COLUMNS = "category, level, metric, scope_type, answer_type, pattern"
_GROUPS = (metrics.device_fields, metrics.flag_partitions, metrics.by_vrf, metrics.by_area_and_as)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


_DATA = facts.common_tables("devices", "vrfs", "areas", "interfaces") + f""", t AS (SELECT * FROM (VALUES {_values(TEMPLATES)}) v({_COLUMNS})),
answers AS ({" UNION ALL ".join(f"SELECT metric, scope, answer FROM ({metric_sql.sql(g.__name__)})" for g in _GROUPS)}),
bound AS (SELECT DISTINCT host, i.vrf, file FROM interfaces i JOIN devices d ON d.ord = i.ord WHERE i.vrf <> ''),
sc AS (SELECT 'GLOBAL' AS scope_type, 'GLOBAL' AS scope, NULL AS host, NULL AS asn, NULL AS vrf, NULL AS area UNION ALL SELECT DISTINCT 'DEVICE', host, host, NULL, NULL, NULL FROM devices
    UNION ALL SELECT DISTINCT 'AS', local_as, NULL, local_as, NULL, NULL FROM devices WHERE local_as <> '' UNION ALL SELECT DISTINCT 'VRF', vrf, NULL, NULL, vrf, NULL FROM vrfs
    UNION ALL SELECT DISTINCT 'OSPF_AREA', area, NULL, NULL, NULL, area FROM areas UNION ALL SELECT DISTINCT 'DEVICE_VRF', host || '/' || vrf, host, NULL, vrf, NULL FROM bound),
asked0 AS (SELECT category, level, metric, scope_type, scope, answer_type, pattern, answer, replace(replace(replace(replace(pattern, '{{host}}', coalesce(host, '{{host}}')), '{{asn}}', coalesce(asn, '{{asn}}')), '{{vrf}}', coalesce(vrf, '{{vrf}}')), '{{area}}', coalesce(area, '{{area}}')) AS q FROM t JOIN answers USING (metric) JOIN sc USING (scope_type, scope)),
asked AS (SELECT category, level, metric, scope_type, scope, answer_type, CASE WHEN regexp_matches(q, '\\{{\\w+\\}}') THEN pattern ELSE q END AS question, answer FROM asked0) """
_BUILT = _DATA + f""", once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, metric, question ORDER BY scope_type, scope) AS k FROM asked) WHERE k = 1),
files AS (SELECT 'DEVICE' AS scope_type, host AS scope, string_agg(DISTINCT file, ', ' ORDER BY file) AS files FROM devices GROUP BY 2 UNION ALL SELECT 'AS', local_as, string_agg(DISTINCT file, ', ' ORDER BY file) FROM devices WHERE local_as <> '' GROUP BY 2
    UNION ALL SELECT 'VRF', vrf, string_agg(DISTINCT file, ', ' ORDER BY file) FROM vrfs v JOIN devices d ON d.ord = v.ord GROUP BY 2 UNION ALL SELECT 'DEVICE_VRF', host || '/' || vrf, string_agg(DISTINCT file, ', ' ORDER BY file) FROM bound GROUP BY 2),
n AS (SELECT o.*, coalesce(files, '') AS source_files, row_number() OVER (PARTITION BY category ORDER BY metric, question) AS place, count(*) OVER (PARTITION BY category) AS total FROM once o LEFT JOIN files f ON f.scope_type = o.scope_type AND f.scope = o.scope),
hints AS (SELECT * FROM (VALUES {_values(datasets.ANSWER_HINTS.items())}) h(answer_type, hint)) """


def _asked(spark, sf):
    t = facts.derived(spark, sf)
    answers = None
    for group in _GROUPS:
        answers = group(t) if answers is None else answers.union(group(t))
    return t, datasets.questions(spark.createDataFrame(TEMPLATES, _COLUMNS.replace(", ", " string, ") + " string"), datasets.scopes_of(t), answers)


@query(_DATA + "SELECT scope_type, metric, count(*) AS n, min(question) AS first_question FROM asked GROUP BY 1, 2")
def scope_expand(spark, sf):
    return _asked(spark, sf)[1].groupBy("scope_type", "metric").agg(F.count("*").alias("n"), F.min("question").alias("first_question"))


@query(_BUILT + "SELECT upper(category) || '_' || lpad(CAST(place AS STRING), 6, '0') AS id, category, n.answer_type, level, question || coalesce(chr(10) || '[Answer format] ' || hint, '') AS question, coalesce(answer, '') AS ground_truth, 'metric `' || metric || '` on ' || scope || ' → ' || coalesce(answer, '') AS explanation, source_files, CASE WHEN place <= floor(total * 0.8) THEN 'train' WHEN place <= floor(total * 0.8) + floor(total * 0.1) THEN 'validation' ELSE 'test' END AS split FROM n LEFT JOIN hints h ON h.answer_type = n.answer_type")
def dataset_build(spark, sf):
    t, asked = _asked(spark, sf)
    built = datasets.build(asked, datasets.scope_files(t))
    return csv_rows(built, ("id", "category", "answer_type", "level", "question", "ground_truth", "explanation", "source_files", "split"))


#: Parts stand for items of policies, nations for metrics of goals.
_POLICY = {
    "policies": "SELECT p_partkey AS no, 'C' || CAST(p_size % 3 AS STRING) AS category, 'L' || CAST(p_size % 2 AS STRING) AS level, p_size AS item_no, 'g' || CAST(p_partkey % 4 AS STRING) AS goal, p_size % 2 = 0 AS two, CASE WHEN p_size % 5 = 0 THEN 'm' || CAST(p_partkey % 30 AS STRING) END AS primary_metric FROM part",
    "goals": "SELECT 'C' || CAST(n_regionkey % 3 AS STRING) AS category, 'g' || CAST(n_nationkey % 4 AS STRING) AS goal, n_nationkey AS place, 'm' || CAST(n_nationkey AS STRING) AS metric FROM nation",
    "allowed": "SELECT 'C' || CAST(n_regionkey % 3 AS STRING) AS category, 'm' || CAST(n_nationkey AS STRING) AS metric FROM nation WHERE n_name > 'C'",
    "patterns": "SELECT 'm' || CAST(n_nationkey AS STRING) AS metric, 'What of ' || n_name || '? ' AS pattern, 'text' AS answer_type FROM nation",
}


@query("WITH " + ", ".join(f"{k} AS ({v})" for k, v in _POLICY.items()) + """,
merged AS (SELECT *, -1 AS place, primary_metric AS metric FROM policies WHERE primary_metric IS NOT NULL UNION ALL SELECT p.*, g.place, g.metric FROM policies p JOIN goals g ON g.category = p.category AND g.goal = p.goal),
r AS (SELECT category, metric, scope_type, level, goal, answer_type, trim('[normal] ' || pattern) AS pattern, row_number() OVER (PARTITION BY category, metric, scope_type ORDER BY no, level, item_no, place, target_no) AS k
    FROM merged JOIN (SELECT DISTINCT * FROM allowed) USING (category, metric) JOIN patterns USING (metric) JOIN (VALUES (true, 0, 'DEVICE'), (true, 1, 'GLOBAL'), (false, 0, 'AS')) v(two, target_no, scope_type) USING (two))
SELECT category, level, goal, metric, scope_type, answer_type, pattern FROM r WHERE k = 1""")
def template_compile(spark, sf):
    read = lambda name, source: spark.sql(_POLICY[name].replace(f"FROM {source}", "FROM {t}"), t=spark.read.parquet(f"{sf}/{source}.parquet"))
    targets = F.when(F.col("two"), F.array(F.lit("DEVICE"), F.lit("NOWHERE"))).otherwise(F.array(F.lit("AS")))
    scopes = spark.createDataFrame([("DEVICE", "DEVICE"), ("AS", "AS")], "target string, scope_type string")
    return datasets.compile_templates(read("policies", "part").withColumn("targets", targets).drop("two"), read("goals", "nation"), read("allowed", "nation"), read("patterns", "nation"), scopes, "[normal] ")
