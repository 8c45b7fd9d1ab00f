"""What-ifs and intents derived from the driver's tables, and SQL that answers every world from scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import scenarios

from . import metric_sql
from .facts import TABLES, common_tables

#: A world for each forty customers; some overrides name what isn't there.
OVERRIDES = """
    SELECT c_custkey // 40 AS world, c_custkey AS no, CASE WHEN c_custkey % 97 = 0 THEN 'nowhere' WHEN c_custkey % 89 = 0 THEN NULL ELSE d.host END AS host,
        CASE c_custkey % 8 WHEN 0 THEN 'device' WHEN 1 THEN 'device' WHEN 2 THEN 'interface:Gi0/' || CAST(d.ord + n * (c_custkey % 7) AS STRING) WHEN 3 THEN 'interface:Gi0/' || CAST(d.ord + n * (c_custkey % 5) AS STRING)
            WHEN 4 THEN 'interface:Gi0/' || CAST(d.ord + n * (c_custkey % 9) AS STRING) WHEN 5 THEN 'bgp_peer:172.16.' || CAST(c_nationkey AS STRING) || '.' || CAST(c_custkey % 200 AS STRING)
            WHEN 6 THEN 'bgp_peer:' || d.loopback ELSE CASE WHEN c_custkey % 3 = 0 THEN 'chassis' ELSE 'device' END END AS component,
        CASE c_custkey % 8 WHEN 0 THEN 'ssh_present' WHEN 1 THEN 'local_as' WHEN 2 THEN 'state' WHEN 3 THEN 'removed' WHEN 4 THEN 'vrf' WHEN 5 THEN CASE WHEN c_custkey % 3 = 0 THEN 'state' ELSE 'removed' END WHEN 6 THEN 'state'
            ELSE CASE WHEN c_custkey % 5 = 0 THEN 'colour' ELSE 'aaa_method' END END AS field,
        CASE c_custkey % 8 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END WHEN 1 THEN CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(65000 + c_custkey % 6 AS STRING) END WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Down' ELSE 'up' END
            WHEN 3 THEN 'true' WHEN 4 THEN CASE c_custkey % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'red' END WHEN 5 THEN CASE WHEN c_custkey % 3 = 0 THEN 'down' ELSE 'true' END WHEN 6 THEN 'down' ELSE 'group tacacs+' END AS value
    FROM customer CROSS JOIN (SELECT count(*) AS n FROM supplier) JOIN devices d ON d.ord = c_custkey % n WHERE c_custkey % 40 < 12"""
#: An intent for each third customer: metrics in turn, some of a world, some with a precondition, some that can't be answered.
ASKED = ("ssh_present_bool", "interface_status_map", "ssh_missing_count", "vrf_bind_map", "devices_in_as", "ibgp_missing_pairs_count", "ssh_missing_devices", "bgp_as_distribution", "no_such_metric", "interfaces_in_vrf", "aaa_present_bool")
INTENTS = f"""
    SELECT c_custkey AS intent, metric, CASE WHEN metric IN ('ssh_missing_count', 'ssh_missing_devices', 'bgp_as_distribution') THEN NULL WHEN metric IN ('devices_in_as', 'ibgp_missing_pairs_count') THEN CAST(65000 + c_custkey % 7 AS STRING)
            WHEN metric = 'interfaces_in_vrf' THEN CASE WHEN c_custkey % 2 = 0 THEN 'red' ELSE 'green' END WHEN metric = 'ssh_present_bool' AND c_custkey % 5 = 0 THEN NULL ELSE host END AS scope,
        CASE WHEN c_custkey % 4 > 0 THEN c_custkey // 40 END AS world, c_custkey % 6 = 0 AS checks, CASE WHEN c_custkey % 5 > 0 THEN host END AS check_host, CASE WHEN c_custkey % 12 = 0 THEN local_as ELSE '65001' END AS check_as
    FROM (SELECT c_custkey, d.host, d.local_as, CASE c_custkey // 3 % {len(ASKED) + 1} {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(ASKED))} END AS metric
        FROM customer CROSS JOIN (SELECT count(*) AS n FROM supplier) JOIN devices d ON d.ord = c_custkey % n WHERE c_custkey % 3 = 0)"""


def derived(spark: SparkSession, sf_dir: str, facts: dict[str, DataFrame], sql: str) -> DataFrame:
    base = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "supplier")}
    text = sql.replace(" // ", " DIV ")
    for name in (*base, "devices"):
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **base, devices=facts["devices"])


_ITEM = "CASE WHEN component LIKE 'interface:%' THEN substr(component, 11) WHEN component LIKE 'bgp_peer:%' THEN substr(component, 10) END"
_TABLE = "CASE WHEN component = 'device' THEN 'devices' WHEN component LIKE 'interface:%' THEN 'interfaces' WHEN component LIKE 'bgp_peer:%' THEN 'neighbors' END"
_FIELD = "CASE WHEN field = 'state' AND component LIKE 'interface:%' AND lower(value) IN ('up', 'down') THEN 'status' WHEN field = 'state' AND component LIKE 'bgp_peer:%' AND lower(value) IN ('up', 'down') THEN 'session' ELSE field END"
_KNOWN = " OR ".join(f"(t = '{t}' AND f IN ({', '.join(repr(f) for f in fields)}))" for t, fields in scenarios.FIELDS.items())
#: The overrides with the reason why one can't be applied.
RESOLVED = f"""o AS (SELECT world, no, host, component, {_TABLE} AS t, {_ITEM} AS item, {_FIELD} AS f, CASE WHEN {_FIELD} IN ('status') THEN lower(value) ELSE value END AS v FROM ({OVERRIDES})),
resolved AS (SELECT o.*, d.ord, CASE WHEN o.host IS NULL OR component IS NULL THEN 'MISSING_TARGET' WHEN t IS NULL THEN 'UNKNOWN_COMPONENT' WHEN d.ord IS NULL THEN 'NO_SUCH_HOST' WHEN NOT ({_KNOWN}) THEN 'UNKNOWN_FIELD'
    WHEN t = 'interfaces' AND NOT EXISTS (SELECT 1 FROM interfaces i WHERE i.ord = d.ord AND i.name = item) OR t = 'neighbors' AND NOT EXISTS (SELECT 1 FROM neighbors i WHERE i.ord = d.ord AND i.peer = item) THEN 'NO_SUCH_ITEM' END AS reason
    FROM o LEFT JOIN devices d ON d.host = o.host),
ov AS (SELECT world, ord, t, coalesce(item, '') AS item, f, arg_max(struct_pack(v := v), no) AS s FROM resolved WHERE reason IS NULL GROUP BY ALL) """
_BASE = common_tables("devices", "users", "servers", "interfaces", "neighbors", "vrfs", "service_vrfs", "xconnects", "areas")


def _over(table: str, field: str, item: str, base: str, kind: str = "VARCHAR") -> str:
    """A field of a world: the override if there is one."""
    o = f"(SELECT any_value(s) FROM ov WHERE ov.world = w.world AND ov.ord = x.ord AND ov.t = '{table}' AND ov.item = {item} AND ov.f = '{field}')"
    return f"CASE WHEN {o} IS NOT NULL THEN CAST({o}.v AS {kind}) ELSE {base} END"


_PREFIX = "w.world || '~' || "
_OVERLAID = ("ssh_present", "ssh_version", "aaa_present", "aaa_method", "local_as", "version", "log_severity")
#: Every world's own facts: keys, hosts, AS numbers and VRFs carry the world's number in front, so the plain metric SQL answers all worlds apart.
_WORLDS = f"""worlds AS (SELECT DISTINCT world FROM ov),
w_devices AS (SELECT {_PREFIX} x.ord AS ord, x.file, {_PREFIX} x.host AS host, x.vty_login, x.vty_transport, x.timezone, x.ldp_enabled, x.ldp_router, x.loopback,
    {', '.join(f"{(_PREFIX if f == 'local_as' else '')} ({_over('devices', f, repr(''), f'x.{f}', 'BOOLEAN' if f.endswith('present') else 'VARCHAR')}) AS {f}" for f in _OVERLAID)} FROM devices x, worlds w),
w_interfaces AS (SELECT {_PREFIX} x.ord AS ord, no, name, {_over('interfaces', 'ipv4', 'x.name', 'x.ipv4')} AS ipv4, CASE WHEN v <> '' THEN world || '~' || v ELSE v END AS vrf, {_over('interfaces', 'status', 'x.name', 'x.status')} AS status
    FROM (SELECT x.*, w.world, {_over('interfaces', 'vrf', 'x.name', 'x.vrf')} AS v, coalesce({_over('interfaces', 'removed', 'x.name', 'NULL')}, 'false') = 'true' AS gone FROM interfaces x, worlds w) x JOIN worlds w USING (world) WHERE NOT gone),
w_neighbors AS (SELECT {_PREFIX} x.ord AS ord, {_over('neighbors', 'vrf', 'x.peer', 'x.vrf')} AS vrf, x.peer, {_PREFIX} ({_over('neighbors', 'remote_as', 'x.peer', 'x.remote_as')}) AS remote_as
    FROM (SELECT x.*, w.world, coalesce({_over('neighbors', 'removed', 'x.peer', 'NULL')}, 'false') = 'true' AS gone FROM neighbors x, worlds w) x JOIN worlds w USING (world) WHERE NOT gone),
w_vrfs AS (SELECT {_PREFIX} x.ord AS ord, {_PREFIX} vrf AS vrf, rd, n_import, n_export FROM vrfs x, worlds w), w_service_vrfs AS (SELECT {_PREFIX} x.ord AS ord, {_PREFIX} vrf AS vrf, rt FROM service_vrfs x, worlds w),
w_areas AS (SELECT {_PREFIX} x.ord AS ord, area, interface, pid FROM areas x, worlds w)"""
_GROUPS = ("device_fields", "interface_metrics", "neighbor_metrics", "routing_entries", "full_mesh", "under_peered", "comparisons", "by_vrf", "by_area_and_as")
_NAMES = tuple(m for of in scenarios.DEPENDENCIES.values() for m in of if m != "bgp_local_as_numeric")


def _in_worlds(body: str) -> str:
    for name in ("devices", "interfaces", "neighbors", "service_vrfs", "vrfs", "areas"):
        for word in ("FROM", "JOIN"):
            body = body.replace(f"{word} {name} ", f"{word} w_{name} ").replace(f"{word} {name})", f"{word} w_{name})")
    return body.replace("x.ord < y.ord", "CAST(split_part(x.ord, '~', 2) AS BIGINT) < CAST(split_part(y.ord, '~', 2) AS BIGINT)") + " "


_ALL = " UNION ALL ".join(f"SELECT metric, scope, answer FROM ({_in_worlds(metric_sql._BODY[g] + ' ')})" for g in _GROUPS)
_PLAIN = " UNION ALL ".join(f"SELECT metric, scope, answer FROM ({metric_sql._BODY[g]})" for g in (*_GROUPS, "flag_partitions"))
_LISTS = {m: f"SELECT world, '{m}' AS metric, coalesce(string_agg(split_part(host, '~', 2), ', ' ORDER BY host) FILTER ({'' if on else 'NOT '}coalesce({flag}, false)), '') AS after FROM (SELECT *, CAST(split_part(ord, '~', 1) AS BIGINT) AS world FROM w_devices) GROUP BY world" for m, (flag, on) in scenarios.FLAGS.items()}
#: What every world answers otherwise than the facts, all of it computed anew.
CHANGED = f"""{_BASE}, {RESOLVED}, {_WORLDS},
base AS ({_PLAIN}),
later AS (SELECT CAST(split_part(scope, '~', 1) AS BIGINT) AS world, metric, replace(scope, split_part(scope, '~', 1) || '~', '') AS scope, replace(answer, split_part(scope, '~', 1) || '~', '') AS after FROM ({_ALL}) WHERE contains(scope, '~') AND metric IN ({', '.join(repr(m) for m in _NAMES)})
    UNION ALL SELECT CAST(split_part(ord, '~', 1) AS BIGINT), 'bgp_local_as_numeric', split_part(host, '~', 2), CAST(coalesce(try_cast(split_part(local_as, '~', 2) AS BIGINT), 0) AS VARCHAR) FROM w_devices
    UNION ALL SELECT world, 'ssh_missing_count', 'GLOBAL', CAST(count(*) FILTER (NOT coalesce(ssh_present, false)) AS VARCHAR) FROM (SELECT *, CAST(split_part(ord, '~', 1) AS BIGINT) AS world FROM w_devices) GROUP BY world),
early AS (SELECT world, metric, scope, answer AS before FROM base, worlds WHERE metric IN ({', '.join(repr(m) for m in (*_NAMES, 'bgp_local_as_numeric', 'ssh_missing_count'))})),
compared AS (SELECT coalesce(l.world, e.world) AS world, coalesce(l.metric, e.metric) AS metric, coalesce(l.scope, e.scope) AS scope, before, after FROM later l FULL JOIN early e ON l.world = e.world AND l.metric = e.metric AND l.scope = e.scope) """
