"""Queries of trees without a schema and of facts as documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import metrics, trees
from factloom.plans import facts, metric_sql
from factloom.registry import query, table
from factloom.sources import facts_files

#: An event around its properties, keys with namespaces, two of which are alike without them.
_EVENT = """'{"ev:event": {"ev:id": ' || event_id || ', "a:kind": "' || event_type || '", "b:kind": "x' || event_id % 3 || '", "ev:props": ' || props || ', "list": [' || user_id || ', [null, {"q:r:deep": true}], {}]}}'"""


@query(f"""WITH RECURSIVE docs AS (SELECT event_id, CAST({_EVENT} AS JSON) AS v FROM events),
t AS (SELECT event_id, '$' AS path, 0 AS depth, v FROM docs
    UNION ALL SELECT event_id, path || s AS path, depth + 1, v FROM (
        SELECT t.event_id, t.path, t.depth, '.' || regexp_extract(k.key, '([^:]*)$', 1) AS s, k.key, json_extract(t.v, '$."' || k.key || '"') AS v, row_number() OVER (PARTITION BY t.event_id, t.path, regexp_extract(k.key, '([^:]*)$', 1) ORDER BY k.key DESC) AS n
        FROM t, LATERAL (SELECT unnest(json_keys(t.v)) AS key) k WHERE json_type(t.v) = 'OBJECT'
        UNION ALL SELECT t.event_id, t.path, t.depth, '[' || i.i || ']', '', json_extract(t.v, '$[' || i.i || ']'), 1 FROM t, LATERAL (SELECT unnest(range(CAST(json_array_length(t.v) AS BIGINT))) AS i) i WHERE json_type(t.v) = 'ARRAY') WHERE n = 1)
SELECT event_id, path, depth, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'scalar' END AS kind, CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(v, '$') END AS value FROM t""")
def tree_nodes(spark, sf):
    made = F.expr(_EVENT.replace("event_id % 3", "CAST(event_id % 3 AS STRING)"))
    return trees.nodes(table(spark, sf, "events").select("event_id", made.alias("json")), ["event_id"], "json")


_GROUPS = (metrics.device_fields, metrics.server_lists, metrics.users, metrics.interface_metrics, metrics.neighbor_metrics, metrics.vrf_metrics, metrics.ospf_metrics, metrics.service_sets)


@query(facts.common_tables(*facts.TABLES) + " UNION ALL ".join(f"SELECT metric, scope, answer FROM ({metric_sql._BODY[g.__name__]})" for g in _GROUPS))
def facts_round_trip(spark, sf):
    """Answers from facts that went through documents and back: the same as from the tables."""
    found = facts_files.documents(facts.derived(spark, sf)).select("ord", F.col("d.file").alias("file"), F.from_json(F.to_json("d"), facts_files.DOCUMENT).alias("d"))
    t = facts_files.staged_tables(found)
    return reduce(DataFrame.union, [g(t) for g in _GROUPS])
