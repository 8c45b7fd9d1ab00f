"""Queries of comparisons, scopes, seeded samples and splits, and technologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import composites, links, metrics, relations
from factloom.plans import facts, metric_sql
from factloom.registry import query, table

_DEVICE = f"answers AS (SELECT metric, scope, answer FROM ({metric_sql._BODY['device_fields']}) UNION ALL SELECT metric, scope, answer FROM ({metric_sql._BODY['interface_metrics']}))"
_ASKS = """SELECT c_custkey AS ask, CASE WHEN c_custkey % 17 = 0 THEN 'causality' ELSE 'comparison' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 'ssh_present_bool' WHEN 1 THEN 'interface_count' WHEN 2 THEN 'no_such_metric' ELSE 'bgp_local_as_numeric' END AS metric,
    'Supplier#' || lpad(CAST(c_custkey % 12 AS STRING), 9, '0') AS a, CASE WHEN c_custkey % 13 > 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 7 AS STRING), 9, '0') END AS b, CASE c_custkey % 5 WHEN 0 THEN '!=' WHEN 1 THEN NULL WHEN 2 THEN '<' ELSE '==' END AS operator FROM customer"""


@query(facts.common_tables("devices", "interfaces") + f""", {_DEVICE}, asks AS ({_ASKS}),
e AS (SELECT ask, operator, CASE WHEN kind <> 'comparison' THEN 'UNKNOWN_KIND' WHEN operator IS NULL OR b IS NULL THEN 'INVALID_COMPARISON' END AS error, x.answer AS p, y.answer AS q FROM asks LEFT JOIN answers x ON x.metric = asks.metric AND x.scope = a LEFT JOIN answers y ON y.metric = asks.metric AND y.scope = b)
SELECT ask, CASE WHEN error IS NULL THEN 'boolean' ELSE 'error' END AS answer_type, CASE WHEN error IS NULL THEN CAST(CASE operator WHEN '==' THEN p IS NOT DISTINCT FROM q WHEN '!=' THEN p IS DISTINCT FROM q ELSE false END AS VARCHAR) END AS answer, error FROM e""")
def composite_comparisons(spark, sf):
    t = facts.derived(spark, sf)
    asks = spark.sql(_ASKS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer")).withColumn("scopes", F.filter(F.array("a", "b"), lambda x: x.isNotNull()))
    return composites.compared_answers(metrics.device_fields(t).union(metrics.interface_metrics(t)), asks)


@query(facts.common_tables("devices", "interfaces", "neighbors") + "SELECT DISTINCT 'DEVICE_PAIR' AS scope_type, x.host || '|' || y.host AS scope FROM (SELECT least(n.ord, d.ord) AS a, greatest(n.ord, d.ord) AS b FROM neighbors n JOIN devices d ON d.loopback = n.peer WHERE n.ord <> d.ord) e JOIN devices x ON x.ord = a JOIN devices y ON y.ord = b UNION ALL SELECT DISTINCT 'INTERFACE', host || '/' || name FROM interfaces i JOIN devices d ON d.ord = i.ord WHERE name <> ''")
def pair_and_interface_scopes(spark, sf):
    t = facts.derived(spark, sf)
    return composites.linked_pairs(t, links.peer_edges(t)).union(composites.interface_scopes(t)).select("scope_type", "scope")


@query("""WITH s AS (SELECT s_name AS scope, row_number() OVER (ORDER BY md5('42:' || s_name), s_name) AS place, count(*) OVER () AS n FROM supplier)
SELECT level, scope FROM (SELECT 'L1' AS level, scope FROM s WHERE place <= greatest(1, floor(n * 0.3)) UNION ALL SELECT 'L2', scope FROM s)""")
def sampled_scopes(spark, sf):
    """Templates of two levels over all devices, of which the first level asks three tenths."""
    scopes = table(spark, sf, "supplier").select(F.lit("DEVICE").alias("scope_type"), F.col("s_name").alias("scope"))
    templates = spark.createDataFrame([("L1", "DEVICE"), ("L2", "DEVICE")], "level string, scope_type string")
    return composites.with_sampled_devices(templates, scopes, 0.3).select("level", "scope")


@query("WITH s AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment, CASE WHEN place <= floor(n * 0.8) THEN 'train' WHEN place <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM s")
def shuffled_split(spark, sf):
    return relations.shuffled_split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], 7)


@query(facts.common_tables(*facts.TABLES) + "SELECT host, coalesce(local_as, '') <> '' OR EXISTS (SELECT 1 FROM neighbors x WHERE x.ord = d.ord) AS bgp, EXISTS (SELECT 1 FROM areas x WHERE x.ord = d.ord) AS ospf, EXISTS (SELECT 1 FROM vrfs x WHERE x.ord = d.ord) OR EXISTS (SELECT 1 FROM service_vrfs x WHERE x.ord = d.ord) AS vrf, EXISTS (SELECT 1 FROM xconnects x WHERE x.ord = d.ord) AS l2vpn, coalesce(ldp_enabled, false) AS mpls, coalesce(ssh_present, false) AS ssh, coalesce(aaa_present, false) AS aaa FROM devices d")
def device_technologies(spark, sf):
    return composites.technologies(facts.derived(spark, sf))


@query(facts.common_tables(*facts.TABLES) + f"SELECT metric, count(DISTINCT item) AS n_items FROM (SELECT metric, unnest(string_split(answer, ', ')) AS item FROM ({metric_sql._BODY['flag_partitions']}) UNION ALL SELECT metric, unnest(string_split(answer, ', ')) FROM ({metric_sql._BODY['by_vrf']})) WHERE item <> '' GROUP BY 1")
def listed_items(spark, sf):
    t = facts.derived(spark, sf)
    return composites.listed(metrics.flag_partitions(t).union(metrics.by_vrf(t)))
