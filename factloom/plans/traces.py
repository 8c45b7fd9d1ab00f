"""Flows, traces and links derived from the driver's tables, in SQL that Spark and others share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: An order is a flow, a line a hop; lines of two parities are two traces of the flow.
TABLES = {
    "flows": """
        SELECT o_orderkey AS flow_id, 'N' || CAST(o_custkey % 25 AS STRING) AS src, 'N' || CAST(o_orderkey % 25 AS STRING) AS dst,
            '10.1.' || CAST(o_custkey % 25 AS STRING) || '.' || CAST(o_custkey % 7 AS STRING) AS src_ip, '10.1.' || CAST(o_orderkey % 25 AS STRING) || '.' || CAST(o_orderkey % 7 AS STRING) AS dst_ip
        FROM orders""",
    "traces": """
        SELECT l_orderkey AS flow_id, l_linenumber % 2 AS trace_no, l_linenumber AS hop_no, 'N' || CAST(l_suppkey % 25 AS STRING) AS node,
            CASE (l_orderkey + l_linenumber % 2) % 7 WHEN 0 THEN 'DENIED_IN' WHEN 1 THEN 'no_route' WHEN 2 THEN 'NULL_ROUTED' WHEN 3 THEN NULL ELSE 'ACCEPTED' END AS disposition,
            CASE WHEN l_partkey % 4 > 0 THEN 'acl' || CAST(l_partkey % 5 AS STRING) END AS filter, l_partkey % 20 AS line, CASE l_partkey % 3 WHEN 0 THEN 'PERMIT' WHEN 1 THEN 'deny' ELSE 'REJECT' END AS action
        FROM lineitem""",
    "members": """
        SELECT DISTINCT 'vrf' || CAST(c_custkey % 5 AS STRING) AS vrf, '10.1.' || CAST(c_custkey % 25 AS STRING) || '.' || CAST(c_custkey % 7 AS STRING) AS ip FROM customer""",
    "mtus": """
        SELECT 'N' || CAST(p_partkey % 25 AS STRING) AS host, 'Gi' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_size % 9 > 0 THEN 1500 + p_size % 3 * 500 END AS mtu FROM part""",
    "cables": """
        SELECT DISTINCT 'N' || CAST(l_partkey % 25 AS STRING) AS host, 'Gi' || CAST(l_partkey AS STRING) AS name, 'N' || CAST((l_partkey + l_linenumber) % 25 AS STRING) AS other_host, 'Gi' || CAST(l_partkey + l_linenumber AS STRING) AS other_name FROM lineitem""",
}
BASE = ("customer", "orders", "lineitem", "part")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of TABLES over the driver's tables."""
    used = [t for t in BASE if f"FROM {t}" in TABLES[name]]
    text = TABLES[name]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_tables(*names: str) -> str:
    """The same derivations as a WITH clause."""
    return "WITH " + ", ".join(f"{name} AS ({TABLES[name]})" for name in names)
