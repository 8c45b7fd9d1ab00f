"""Device facts as normalized tables. TABLES derives a set of them from the driver's tables, in SQL that Spark and others share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ord is a device's place in file order; host falls back to the file's name.
TABLES = {
    "devices": """
        SELECT s_suppkey AS ord, 'dev' || CAST(s_suppkey AS STRING) || '.xml' AS file, CASE WHEN s_suppkey % 17 = 0 THEN 'dev' || CAST(s_suppkey AS STRING) || '.xml' ELSE s_name END AS host,
            CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'informational' END AS log_severity, CASE WHEN s_suppkey % 3 = 0 THEN 'local' END AS vty_login,
            CASE WHEN s_suppkey % 5 = 0 THEN 'ssh' END AS vty_transport, CASE WHEN s_suppkey % 3 > 0 THEN '15.' || CAST(s_suppkey % 4 AS STRING) END AS version, CASE WHEN s_suppkey % 6 > 0 THEN 'UTC' END AS timezone,
            CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_suppkey % 4 <> 0 END AS ssh_present, CASE WHEN s_suppkey % 2 = 0 THEN '1.99' END AS ssh_version,
            CASE s_suppkey % 6 WHEN 0 THEN 'group TACACS+' WHEN 1 THEN 'group radius' WHEN 2 THEN 'local' WHEN 3 THEN 'line' END AS aaa_method, s_suppkey % 6 < 5 AS aaa_present,
            s_suppkey % 7 = 0 AS ldp_enabled, CASE WHEN s_suppkey % 14 = 0 THEN '10.9.0.' || CAST(s_suppkey % 250 AS STRING) END AS ldp_router,
            CASE s_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE CAST(65000 + s_nationkey % 5 AS STRING) END AS local_as,
            '10.' || CAST(s_suppkey // 62500 AS STRING) || '.' || CAST(s_suppkey // 250 % 250 AS STRING) || '.' || CAST(s_suppkey % 250 AS STRING) AS loopback
        FROM supplier""",
    "users": "SELECT c_custkey % (SELECT count(*) FROM supplier) AS ord, CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE lower(c_mktsegment) END AS name FROM customer",
    "servers": """
        SELECT c_custkey % (SELECT count(*) FROM supplier) AS ord, CASE c_custkey % 3 WHEN 0 THEN 'ntp' WHEN 1 THEN 'snmp' ELSE 'syslog' END AS kind, 'srv' || CAST(c_nationkey AS STRING) AS value
        FROM customer WHERE c_custkey % 2 = 0""",
    "interfaces": """
        SELECT p_partkey % (SELECT count(*) FROM supplier) AS ord, p_partkey AS no, CASE WHEN p_size % 7 = 0 THEN 'Gi0/' || CAST(p_partkey AS STRING) || '.10' ELSE 'Gi0/' || CAST(p_partkey AS STRING) END AS name,
            CASE WHEN p_size % 5 > 0 THEN '192.168.' || CAST(p_partkey % 90 AS STRING) || '.' || CAST(p_size AS STRING) END AS ipv4,
            CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'red' WHEN 3 THEN 'blue' END AS vrf, CASE p_size % 9 WHEN 0 THEN 'down' WHEN 1 THEN NULL ELSE 'up' END AS status
        FROM part WHERE p_partkey % (SELECT count(*) FROM supplier) % 8 <> 3""",
    "neighbors": """
        SELECT a.s_suppkey AS ord, CAST(NULL AS STRING) AS vrf, '10.' || CAST(b.s_suppkey // 62500 AS STRING) || '.' || CAST(b.s_suppkey // 250 % 250 AS STRING) || '.' || CAST(b.s_suppkey % 250 AS STRING) AS peer, CAST(65000 + b.s_nationkey % 5 AS STRING) AS remote_as
        FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE (a.s_suppkey * 7 + b.s_suppkey * 3) % 4 > 0
        UNION ALL
        SELECT c_custkey % (SELECT count(*) FROM supplier), CASE WHEN c_custkey % 4 > 0 THEN 'vrf' || CAST(c_custkey % 4 AS STRING) END, CASE WHEN c_custkey % 31 > 0 THEN '172.16.' || CAST(c_nationkey AS STRING) || '.' || CAST(c_custkey % 200 AS STRING) END,
            CASE WHEN c_custkey % 29 > 0 THEN CAST(65000 + c_nationkey % 7 AS STRING) END
        FROM customer WHERE c_custkey % 5 = 0""",
    "vrfs": """
        SELECT DISTINCT c_custkey % (SELECT count(*) FROM supplier) AS ord, 'vrf' || CAST(c_nationkey % 4 AS STRING) AS vrf, CASE WHEN c_nationkey % 4 > 0 THEN '65000:' || CAST(c_nationkey % 4 AS STRING) END AS rd, c_nationkey % 4 AS n_import, c_nationkey % 3 AS n_export
        FROM customer WHERE c_custkey % 6 = 0""",
    "service_vrfs": """
        SELECT DISTINCT c_custkey % (SELECT count(*) FROM supplier) AS ord, CASE c_nationkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'vrf1' END AS vrf, CASE WHEN c_nationkey % 5 > 0 THEN '65000:' || CAST(c_nationkey AS STRING) END AS rt
        FROM customer WHERE c_custkey % 7 = 0""",
    "xconnects": """
        SELECT a.s_suppkey AS ord, b.s_suppkey AS no, CASE WHEN b.s_suppkey % 9 = 0 THEN '10.250.0.1' ELSE '10.' || CAST(b.s_suppkey // 62500 AS STRING) || '.' || CAST(b.s_suppkey // 250 % 250 AS STRING) || '.' || CAST(b.s_suppkey % 250 AS STRING) END AS neighbor,
            CASE WHEN (a.s_suppkey + b.s_suppkey) % 8 > 0 THEN CAST(CASE WHEN a.s_suppkey % 3 = 0 THEN a.s_suppkey + b.s_suppkey + 1 ELSE a.s_suppkey + b.s_suppkey END AS STRING) END AS pw
        FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE (a.s_suppkey + 2 * b.s_suppkey) % 5 > 1""",
    "areas": """
        SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS ord, CAST(p_size % 3 AS STRING) AS area, 'Gi0/' || CAST(p_size AS STRING) AS interface, CAST(p_size % 2 + 1 AS STRING) AS pid
        FROM part WHERE p_size % 4 = 0""",
}
BASE = ("customer", "supplier", "part")
#: Pairs of suppliers that one task derives, about.
_PAIRS = 1_000_000


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """TABLES over the driver's tables.

    The pairs of suppliers of a nation grow with the square of their number, while the table is one task's file: its
    side of the join is spread over as many tasks as its pairs need.
    """
    base = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in BASE}
    pairs = base["supplier"].groupBy("s_nationkey").count().agg(F.sum(F.pow("count", F.lit(2)))).first()[0] or 0
    spread = base["supplier"].repartition(math.ceil(pairs / _PAIRS), "s_suppkey") if pairs > _PAIRS else base["supplier"]
    out = {}
    for name, sql in TABLES.items():
        text = sql.replace(" // ", " DIV ").replace("FROM supplier a", "FROM {spread} a")
        for table in BASE:
            text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
        out[name] = spark.sql(text, **{t: rows for t, rows in {**base, "spread": spread}.items() if f"{{{t}}}" in text})
    return out


def common_tables(*names: str) -> str:
    """The same derivations as a WITH clause."""
    return "WITH " + ", ".join(f"{name} AS ({TABLES[name]})" for name in names) + " "
