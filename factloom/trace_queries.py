"""Queries of reachability over the traces that factloom.plans.traces derives, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import traces as tr
from factloom.plans.traces import derived, with_tables
from factloom.registry import query, table

_OK = "coalesce(upper(disposition) LIKE '%ACCEPTED%', false)"
_T, _FT = with_tables("traces"), with_tables("flows", "traces")
#: p: each trace's path, nodes where they are met first.
_PATHS = f"""
, f AS (SELECT flow_id, trace_no, node, min(hop_no) AS hop, count(*) AS n, bool_or({_OK}) AS ok FROM traces GROUP BY 1, 2, 3),
p AS (SELECT flow_id, trace_no, list(node ORDER BY hop, node) AS path, CAST(sum(n) AS BIGINT) AS n_hops, bool_or(ok) AS accepted FROM f GROUP BY 1, 2) """
_FIRST = _PATHS + ", q AS (SELECT flow_id, arg_min(path, trace_no) AS path, arg_min(n_hops, trace_no) AS n_hops FROM p GROUP BY 1) "


def _traces(spark, sf):
    return derived(spark, sf, "traces")


def _flows(spark, sf):
    return derived(spark, sf, "flows")


@query(_T + _FIRST + "SELECT flow_id, array_to_string(path, ' -> ') AS path, n_hops FROM q")
def trace_first_path(spark, sf):
    return tr.first_paths(_traces(spark, sf)).select("flow_id", F.array_join("path", " -> ").alias("path"), "n_hops")


@query(_T + f", m AS (SELECT flow_id, node, min(trace_no * 1000 + hop_no) AS first_at FROM traces GROUP BY 1, 2), n AS (SELECT flow_id, string_agg(node, ' -> ' ORDER BY first_at, node) AS nodes FROM m GROUP BY 1) SELECT flow_id, bool_or({_OK}) AS reachable, count(DISTINCT trace_no) AS n_traces, any_value(nodes) AS nodes FROM traces JOIN n USING (flow_id) GROUP BY 1")
def trace_reachability(spark, sf):
    return tr.reachability(_traces(spark, sf)).withColumn("nodes", F.array_join("nodes", " -> "))


@query(_T + ", d AS (SELECT flow_id, node, row_number() OVER (PARTITION BY flow_id ORDER BY trace_no, hop_no DESC, node DESC) AS k FROM traces WHERE upper(disposition) LIKE '%DENIED%') SELECT flow_id, node FROM d WHERE k = 1")
def trace_blocking_node(spark, sf):
    return tr.blocking_nodes(_traces(spark, sf))


@query(_T + ", r AS (SELECT flow_id, node || ':' || filter || ':Line ' || line AS rule, min(trace_no * 1000 + hop_no) AS first_at FROM traces WHERE upper(action) IN ('DENY', 'REJECT') AND filter IS NOT NULL GROUP BY 1, 2) SELECT flow_id, string_agg(rule, ', ' ORDER BY first_at, rule) AS rules FROM r GROUP BY 1")
def trace_blocking_rules(spark, sf):
    return tr.blocking_rules(_traces(spark, sf))


@query(_T + ", a AS (SELECT flow_id, trace_no, node FROM traces GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT flow_id, trace_no, string_agg(node, ', ' ORDER BY node) AS nodes FROM a GROUP BY 1, 2")
def trace_loops(spark, sf):
    return tr.loops(_traces(spark, sf))


@query(_FT + ", t AS (SELECT flow_id, count(DISTINCT trace_no) AS n, coalesce(string_agg(DISTINCT disposition, ', ' ORDER BY disposition) FILTER (regexp_matches(upper(disposition), 'DROP|NULL|NO_ROUTE|DENIED')), '') AS d FROM traces GROUP BY 1) SELECT f.flow_id, coalesce(n, 0) AS n_traces, coalesce(d, '') AS dispositions FROM flows f LEFT JOIN t ON t.flow_id = f.flow_id WHERE n IS NULL OR d <> ''")
def trace_blackholes(spark, sf):
    return tr.blackholes(_flows(spark, sf), _traces(spark, sf))


@query(_FT + " SELECT f.flow_id, lower(f.dst) AS waypoint, EXISTS (SELECT 1 FROM traces t WHERE t.flow_id = f.flow_id AND lower(t.node) = lower(f.dst)) AS passed FROM flows f")
def trace_waypoints(spark, sf):
    return tr.waypoints(_traces(spark, sf), _flows(spark, sf).select("flow_id", F.lower("dst").alias("waypoint")))


@query(_FT + f", t AS (SELECT flow_id, trace_no, bool_or({_OK}) AS ok, bool_or(node = 'N7') AS met FROM traces GROUP BY 1, 2) SELECT DISTINCT flow_id FROM flows JOIN t USING (flow_id) WHERE dst = 'N3' AND ok AND NOT met")
def trace_policy_violations(spark, sf):
    return tr.policy_violations(_flows(spark, sf), _traces(spark, sf), "N3", "n7")


@query(with_tables("flows", "traces", "members") + f", r AS (SELECT flow_id FROM traces GROUP BY 1 HAVING bool_or({_OK})) SELECT DISTINCT a.vrf, b.vrf AS other, dst_ip || '/32' AS leak FROM flows JOIN r USING (flow_id) JOIN members a ON a.ip = src_ip JOIN members b ON b.ip = dst_ip WHERE a.vrf <> b.vrf")
def trace_vrf_leaks(spark, sf):
    return tr.leaks(_flows(spark, sf), _traces(spark, sf), derived(spark, sf, "members"))


@query(_FT + _FIRST + ", o AS (SELECT src, dst, min(flow_id) AS flow_id FROM flows WHERE src <> dst GROUP BY 1, 2), w AS (SELECT src, dst, path FROM o JOIN q USING (flow_id)) SELECT x.src AS a, x.dst AS b, array_to_string(x.path, ' -> ') AS there, array_to_string(y.path, ' -> ') AS back, x.path = list_reverse(y.path) AS is_symmetric FROM w x JOIN w y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def trace_asymmetry(spark, sf):
    return tr.asymmetric(_flows(spark, sf), _traces(spark, sf))


@query(_T + _PATHS + ", s AS (SELECT flow_id, any_value(path) AS path FROM p GROUP BY 1 HAVING count(*) = 1), u AS (SELECT unnest(path[2:len(path) - 1]) AS node FROM s WHERE len(path) > 2) SELECT node, count(*) AS n_flows FROM u GROUP BY 1")
def trace_single_points(spark, sf):
    return tr.single_points(_traces(spark, sf))


@query(_T + """, l AS (SELECT flow_id, trace_no, lower(node) AS a, lower(lead(node) OVER (PARTITION BY flow_id, trace_no ORDER BY hop_no, node)) AS b FROM traces),
e AS (SELECT flow_id, trace_no, max(CASE WHEN ((contains(a, 'n2') OR contains('n2', a)) AND (contains(b, 'n5') OR contains('n5', b))) OR ((contains(a, 'n5') OR contains('n5', a)) AND (contains(b, 'n2') OR contains('n2', b))) THEN 1 ELSE 0 END) AS u FROM l GROUP BY 1, 2)
SELECT flow_id, count(*) AS n_traces, CAST(sum(u) AS BIGINT) AS n_using, CASE WHEN sum(u) = 0 THEN 'no impact' WHEN sum(u) < count(*) THEN 'reroute' ELSE 'outage' END AS impact FROM e GROUP BY 1""")
def trace_link_failure(spark, sf):
    return tr.link_failure(_traces(spark, sf), "N2", "N5")


@query(_T + _PATHS + "SELECT flow_id, count(DISTINCT path) AS n_paths, count(DISTINCT path) > 1 AS tolerant FROM p WHERE accepted GROUP BY 1")
def trace_multiplicity(spark, sf):
    return tr.multiplicity(_traces(spark, sf))


@query(_T + f", b AS (SELECT flow_id, bool_or({_OK}) AS before FROM traces WHERE trace_no = 0 GROUP BY 1), a AS (SELECT flow_id, bool_or({_OK}) AS after FROM traces WHERE trace_no = 1 GROUP BY 1) SELECT coalesce(b.flow_id, a.flow_id) AS flow_id, before, after FROM b FULL JOIN a ON a.flow_id = b.flow_id WHERE before IS DISTINCT FROM after")
def trace_differential(spark, sf):
    """The traces of one parity stand for the network before a change, those of the other after it."""
    t = _traces(spark, sf)
    return tr.differential(t.where("trace_no = 0"), t.where("trace_no = 1"))


@query("WITH n AS (SELECT n_name AS node, n_nationkey AS ord, min('10.1.' || n_nationkey || '.' || s_suppkey) AS ip FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT a.node AS src, b.node AS dst, proto, port, b.ip AS dst_ip FROM n a JOIN n b ON a.ord < b.ord CROSS JOIN (VALUES ('TCP', 22), ('ICMP', NULL)) v(proto, port) WHERE b.ip IS NOT NULL AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = b.ord)")
def trace_representative_flows(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("ord"), F.concat(F.lit("10.1."), F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_suppkey").cast("string")).alias("ip"))
    nodes = table(spark, sf, "nation").select(F.col("n_name").alias("node"), F.col("n_nationkey").alias("ord")).join(s.groupBy("ord").agg(F.array(F.min("ip")).alias("ips")), "ord", "left")
    return tr.representative_flows(nodes)


@query(with_tables("mtus", "cables") + " SELECT c.host, c.name, other_host, other_name, a.mtu, b.mtu AS other_mtu FROM cables c JOIN mtus a ON a.host = c.host AND a.name = c.name JOIN mtus b ON b.host = other_host AND b.name = other_name WHERE a.mtu <> b.mtu")
def trace_mtu_mismatches(spark, sf):
    return tr.mtu_mismatches(derived(spark, sf, "cables"), derived(spark, sf, "mtus"))
