"""Queries of contexts, device texts, comparisons and counts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import configs
from factloom.operators import contexts, metrics
from factloom.plans import facts
from factloom.registry import query, table

_COUNTS = facts.common_tables("devices", "interfaces", "neighbors", "areas") + """, k AS (SELECT d.ord, host, local_as, coalesce(n_if, 0) AS n_if, coalesce(n_bgp, 0) AS n_bgp, coalesce(areas, '') AS areas FROM devices d
    LEFT JOIN (SELECT ord, count(*) AS n_if FROM interfaces GROUP BY 1) i ON i.ord = d.ord LEFT JOIN (SELECT ord, count(*) AS n_bgp FROM neighbors WHERE vrf IS NULL GROUP BY 1) n ON n.ord = d.ord
    LEFT JOIN (SELECT ord, string_agg(DISTINCT area, ' ' ORDER BY area) AS areas FROM areas GROUP BY 1) a ON a.ord = d.ord) """


@query(_COUNTS + "SELECT x.host AS a, y.host AS b, x.n_if - y.n_if AS interfaces, x.n_bgp - y.n_bgp AS neighbors, x.local_as IS NOT DISTINCT FROM y.local_as AS same_as, x.areas = y.areas AS same_areas FROM k x JOIN k y ON y.ord = x.ord + 1")
def device_compare(spark, sf):
    """Each device with the next in file order, which has no gaps."""
    t = facts.derived(spark, sf)
    d = t["devices"].select("ord", "host")
    pairs = d.select("ord", F.col("host").alias("a")).join(d.select((F.col("ord") - 1).alias("ord"), F.col("host").alias("b")), "ord")
    return metrics.compared(t, pairs)


@query(_COUNTS + "SELECT 'max_interfaces' AS condition, host FROM k WHERE n_if = (SELECT max(n_if) FROM k) UNION ALL SELECT 'min_interfaces', host FROM k WHERE n_if = (SELECT min(n_if) FROM k) UNION ALL SELECT 'ssh_enabled', host FROM devices WHERE ssh_present UNION ALL SELECT 'aaa_enabled', host FROM devices WHERE aaa_present UNION ALL SELECT 'bgp_configured', host FROM devices WHERE TRY_CAST(local_as AS BIGINT) > 0")
def device_search(spark, sf):
    t = facts.derived(spark, sf)
    d, counts = t["devices"], metrics.device_counts(t).select("host", "n_if")
    edges = counts.agg(F.max("n_if").alias("hi"), F.min("n_if").alias("lo"))
    tied = lambda name, c: counts.join(F.broadcast(edges), F.col("n_if") == F.col(c)).select(F.lit(name).alias("condition"), "host")
    where = lambda name, cond: d.where(cond).select(F.lit(name).alias("condition"), "host")
    return tied("max_interfaces", "hi").union(tied("min_interfaces", "lo")).union(where("ssh_enabled", "ssh_present")).union(where("aaa_enabled", "aaa_present")).union(where("bgp_configured", F.col("local_as").try_cast("long") > 0))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url, '^[a-z]+:', ''), '/+', '/', 'g'), '/') AS path FROM pages")
def path_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", configs.normal_path(F.regexp_replace("url", "^[a-z]+:", "")).alias("path"))


@query("SELECT doc_id, array_to_string(list_distinct_order, ' ') AS path, CAST(len(list_distinct_order) AS BIGINT) AS hops FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_order FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b') AS l FROM documents))")
def traceroute_parse(spark, sf):
    """The addresses of whole texts in order."""
    path = configs.traceroute_path(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(path, " ").alias("path"), F.size(path).cast("long").alias("hops"))


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS ratio FROM orders GROUP BY 1")
def value_ratio(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))
    return o.join(F.broadcast(o.agg(F.sum("n").alias("total"))), how="cross").select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


@query("SELECT c_custkey, coalesce(bool_or(o_orderstatus = 'F'), false) AS any_closed, coalesce(bool_and(o_orderstatus = 'F'), true) AS all_closed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def any_all(spark, sf):
    """No orders: none is closed, and all are."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("x"), F.bool_and(F.col("o_orderstatus") == "F").alias("y"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("x", F.lit(False)).alias("any_closed"), F.coalesce("y", F.lit(True)).alias("all_closed"))


@query("SELECT n_nationkey, round(s, 6) AS score, CASE WHEN s < 10 THEN 'simple' WHEN s < 30 THEN 'medium' ELSE 'complex' END AS band FROM (SELECT n_nationkey, 0.3::DOUBLE * coalesce(a, 0) + 0.2::DOUBLE * coalesce(b, 0) + 0.3::DOUBLE * (n_regionkey) + 0.2::DOUBLE * (n_nationkey % 7) AS s FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS a FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS b FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)")
def network_complexity(spark, sf):
    n = table(spark, sf, "nation")
    for name, source, key in (("a", "customer", "c_nationkey"), ("b", "supplier", "s_nationkey")):
        n = n.join(table(spark, sf, source).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name)), "n_nationkey", "left")
    made = configs.complexity(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), F.col("n_regionkey"), F.col("n_nationkey") % 7)
    return n.select("n_nationkey", made.alias("c")).select("n_nationkey", F.round("c.score", 6).alias("score"), "c.band")


@query("SELECT c_mktsegment AS category, need - n AS missing FROM (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) JOIN (SELECT c_mktsegment, count(*) // 2 AS need FROM customer GROUP BY 1) USING (c_mktsegment) WHERE need > n")
def coverage_missing(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "category")
    return contexts.filled_budget(c.where("c_acctbal < 0"), c.groupBy("category").agg(F.expr("count(*) div 2").alias("need")))


@query("WITH b AS (SELECT o_custkey AS qid, o_orderkey % 50 AS doc_id, min((o_orderkey % 3) * 100000000 + o_orderkey) AS first_at FROM orders GROUP BY 1, 2), r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY first_at, doc_id) AS rank FROM b) SELECT qid, rank, doc_id FROM r WHERE rank <= 3")
def multi_query_merge(spark, sf):
    return contexts.merged(table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 3).alias("query_no"), F.col("o_orderkey").alias("rank"), (F.col("o_orderkey") % 50).alias("doc_id")), 3)


@query("WITH f AS (SELECT conv_id, turn, '[METADATA]' || chr(10) || 'role: ' || role || chr(10) || 'turn: ' || turn || chr(10) || chr(10) || '[CONTENT]' || chr(10) || text AS part FROM conversations) SELECT conv_id AS qid, md5(string_agg(part, chr(10) || chr(10) ORDER BY turn)) AS context_md5 FROM f GROUP BY 1")
def context_build(spark, sf):
    meta = F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("role"), F.col("role"), F.lit("source"), F.lit("hidden"))
    found = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), "text", meta.alias("meta"))
    return contexts.contexts(found).select("qid", F.md5("context").alias("context_md5"))
