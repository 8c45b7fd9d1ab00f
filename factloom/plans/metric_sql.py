"""The metric groups in plain SQL over the same derived tables: what the registry's answers are held against."""

from __future__ import annotations

from .facts import common_tables

_SET = "coalesce(string_agg(DISTINCT {0}, ', ' ORDER BY {0}), '')"


def _set(x: str) -> str:
    return _SET.format(x)


def _rows(relation: str, scope: str, answers: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, {scope} AS scope, CAST({v} AS STRING) AS answer FROM ({relation})" for k, v in answers.items())


def _child(name: str, columns: str) -> str:
    """Devices with aggregates of a child table."""
    return f"SELECT d.ord, any_value(d.host) AS host, {columns} FROM devices d LEFT JOIN {name} c ON c.ord = d.ord GROUP BY d.ord"


_INTERFACES = "(SELECT *, row_number() OVER (PARTITION BY ord, name ORDER BY no DESC) = 1 AS top FROM interfaces)"
_PAIRS = "SELECT x.local_as AS asn, x.host || '<->' || y.host AS pair FROM devices x JOIN devices y ON x.local_as = y.local_as AND x.ord < y.ord WHERE x.local_as <> '' AND NOT (EXISTS (SELECT 1 FROM neighbors n WHERE n.ord = x.ord AND n.vrf IS NULL AND n.peer = y.loopback) AND EXISTS (SELECT 1 FROM neighbors n WHERE n.ord = y.ord AND n.vrf IS NULL AND n.peer = x.loopback))"
_MESH = f"SELECT a.asn, count(DISTINCT p.pair) AS n, list_sort(list_distinct(list(p.pair) FILTER (p.pair IS NOT NULL))) AS l FROM (SELECT DISTINCT local_as AS asn FROM devices WHERE local_as <> '') a LEFT JOIN ({_PAIRS}) p ON p.asn = a.asn GROUP BY a.asn"
_LOW = "SELECT d.local_as, d.host, (SELECT count(DISTINCT peer) FROM neighbors n WHERE n.ord = d.ord AND n.vrf IS NULL) < (SELECT count(DISTINCT loopback) FROM devices e WHERE e.local_as = d.local_as) - 1 AS low FROM devices d WHERE d.local_as <> ''"
_FIRST = "SELECT *, row_number() OVER (PARTITION BY ord, neighbor ORDER BY no) AS k FROM xconnects"
_LINKS = f"""SELECT a || '<->' || b AS pair, pw, r.ord IS NOT NULL AS back, r.pw AS back_pw FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY no) AS j FROM (SELECT c.no, c.pw, d.host AS a, d.loopback AS a_ip, coalesce(e.host, 'UNKNOWN') AS b, e.ord AS b_ord FROM xconnects c JOIN devices d ON d.ord = c.ord LEFT JOIN devices e ON e.loopback = c.neighbor)) x
    LEFT JOIN (SELECT ord, neighbor, pw AS pw FROM ({_FIRST}) WHERE k = 1) r ON r.ord = x.b_ord AND r.neighbor = x.a_ip WHERE x.j = 1""".replace("pair, pw,", "pair, x.pw AS pw,")
_COUNTS = "SELECT d.ord, d.host, d.local_as, (SELECT count(*) FROM interfaces i WHERE i.ord = d.ord) AS n_if, (SELECT count(*) FROM neighbors n WHERE n.ord = d.ord AND n.vrf IS NULL) AS n_bgp, (SELECT count(*) FROM vrfs v WHERE v.ord = d.ord) AS n_vrf, coalesce((SELECT string_agg(DISTINCT area, ' ' ORDER BY area) FROM areas a WHERE a.ord = d.ord), '') AS areas FROM devices d"
_TWO = f"SELECT x.host AS h, y.host AS g, x.n_bgp AS b1, y.n_bgp AS b2, x.n_if AS i1, y.n_if AS i2, x.n_vrf AS v1, y.n_vrf AS v2, x.local_as AS l1, y.local_as AS l2, x.areas AS a1, y.areas AS a2 FROM ({_COUNTS}) x JOIN ({_COUNTS}) y ON x.local_as = y.local_as AND x.ord < y.ord WHERE x.local_as <> ''"
_BOUND = "SELECT i.ord, i.vrf, d.host FROM interfaces i JOIN devices d ON d.ord = i.ord WHERE i.vrf <> ''"


def _difference(a: str, b: str) -> str:
    return f"h || ': ' || {a} || ', ' || g || ': ' || {b} || ' (difference ' || abs({a} - {b}) || ')'"


_BODY = {
    "device_fields": _rows("SELECT * FROM devices", "host", {
        "system_hostname_text": "host", "logging_buffered_severity_text": "coalesce(log_severity, '')", "vty_login_mode_text": "coalesce(vty_login, '')", "vty_transport_input_text": "coalesce(vty_transport, '')", "system_version_text": "coalesce(version, '')", "system_timezone_text": "coalesce(timezone, '')",
        "ssh_present_bool": "CASE WHEN ssh_present THEN 'SSHv' || coalesce(nullif(ssh_version, ''), '2') ELSE 'disabled' END", "ssh_version_text": "coalesce(ssh_version, '')",
        "aaa_present_bool": "CASE WHEN NOT coalesce(aaa_present, false) THEN 'not set' WHEN aaa_method ILIKE '%tacacs%' THEN 'TACACS+' WHEN aaa_method ILIKE '%radius%' THEN 'RADIUS' ELSE 'Local' END",
        "mpls_ldp_present_bool": "CASE WHEN NOT ldp_enabled THEN 'disabled' WHEN ldp_router IS NULL THEN 'enabled' ELSE 'enabled (Router-ID ' || ldp_router || ')' END", "bgp_local_as_numeric": "coalesce(try_cast(local_as AS BIGINT), 0)",
    }),
    "server_lists": _rows(_child("servers", f"coalesce(string_agg(c.value, ', ' ORDER BY c.value) FILTER (c.kind = 'ntp'), '') AS ntp, {_set('CASE WHEN c.kind = $snmp THEN c.value END')} AS snmp, {_set('CASE WHEN c.kind = $syslog THEN c.value END')} AS syslog".replace("$snmp", "'snmp'").replace("$syslog", "'syslog'")), "host", {"ntp_server_list": "ntp", "snmp_community_list": "snmp", "syslog_server_list": "syslog"}),
    "users": _rows(_child("users", f"{_set('nullif(c.name, $)').replace('$', chr(39) * 2)} AS names, count(nullif(c.name, '')) AS n"), "host", {"system_user_list": "names", "system_user_count": "n"}),
    "interface_metrics": _rows(_child(_INTERFACES, "count(c.ord) AS n, count(*) FILTER (c.name LIKE '%.%') AS sub, " + ", ".join(f"coalesce(string_agg(c.name || '=' || {v}, ', ' ORDER BY c.name || '=' || {v}) FILTER (c.top), '') AS {k}" for k, v in (("ips", "coalesce(c.ipv4, '')"), ("binds", "coalesce(nullif(c.vrf, ''), 'default')"), ("states", "coalesce(nullif(c.status, ''), 'unknown')")))), "host", {"interface_count": "n", "interface_ip_map": "ips", "subinterface_count": "sub", "vrf_bind_map": "binds", "interface_status_map": "states"}),
    "neighbor_metrics": _rows(_child("neighbors", "count(c.ord) AS n, " + _set("CASE WHEN c.remote_as = d.local_as THEN c.peer END") + " AS i, " + _set("CASE WHEN c.remote_as IS NOT NULL AND c.remote_as IS DISTINCT FROM d.local_as THEN c.peer END") + " AS e"), "host", {"bgp_neighbor_count": "n", "neighbor_list_ibgp": "i", "neighbor_list_ebgp": "e"}),
    "vrf_metrics": _rows(_child("vrfs", _set("c.vrf") + " AS names, count(DISTINCT c.vrf) AS n, " + _set("(c.vrf || '=' || coalesce(c.rd, ''))") + " AS rds, coalesce(sum(n_import), 0) AS imports, coalesce(sum(n_export), 0) AS exports"), "host", {"vrf_names_set": "names", "vrf_count": "n", "vrf_rd_map": "rds", "rt_import_count": "imports", "rt_export_count": "exports"}),
    "ospf_metrics": _rows(_child("areas", f"{_set('c.pid')} AS pids, {_set('c.area')} AS a, " + _set("CASE WHEN c.area = '0' THEN c.interface END") + " AS z, count(DISTINCT CASE WHEN c.area = '0' THEN c.interface END) AS n"), "host", {"ospf_process_ids_set": "pids", "ospf_area_set": "a", "ospf_area0_if_list": "z", "ospf_area0_if_count": "n"}),
    "service_sets": _rows(_child("xconnects", _set("c.pw") + " AS x"), "host", {"l2vpn_pw_id_set": "x"}) + " UNION ALL " + _rows(_child("service_vrfs", _set("c.rt") + " AS x"), "host", {"vrf_rt_list_per_device": "x"}),
    "routing_entries": _rows("SELECT d.host, (SELECT count(*) FROM neighbors n WHERE n.ord = d.ord) + (SELECT count(*) FROM areas n WHERE n.ord = d.ord) + (SELECT count(*) FROM interfaces n WHERE n.ord = d.ord) AS n FROM devices d", "host", {"routing_table_entry_count": "n"}),
    "full_mesh": _rows(_MESH, "asn", {"ibgp_fullmesh_ok": "CASE WHEN n = 0 THEN 'complete' WHEN n <= 5 THEN array_to_string(l, ', ') ELSE array_to_string(l[1:5], ', ') || ' and ' || (n - 5) || ' more' END", "ibgp_missing_pairs": "coalesce(array_to_string(l, ', '), '')", "ibgp_missing_pairs_count": "n"}),
    "under_peered": _rows(f"SELECT local_as, {_set('CASE WHEN low THEN host END')} AS x, count(*) FILTER (low) AS n FROM ({_LOW}) GROUP BY local_as", "local_as", {"ibgp_under_peered_devices": "x", "ibgp_under_peered_count": "n"}),
    "l2vpn_metrics": _rows(f"SELECT {_set('pair')} AS p, {_set('CASE WHEN NOT back THEN pair END')} AS u, count(*) FILTER (NOT back) AS nu, {_set('CASE WHEN back AND pw <> back_pw THEN pair END')} AS m, count(*) FILTER (back AND pw <> back_pw) AS nm FROM ({_LINKS})", "'GLOBAL'", {"l2vpn_pairs": "p", "l2vpn_unidirectional_pairs": "u", "l2vpn_unidir_count": "nu", "l2vpn_pwid_mismatch_pairs": "m", "l2vpn_mismatch_count": "nm"}),
    "vrf_without_rt": _rows(f"SELECT {_set('pair')} AS p, count(DISTINCT pair) AS n FROM (SELECT d.host || '/' || s.vrf AS pair FROM service_vrfs s JOIN devices d ON d.ord = s.ord GROUP BY d.host, s.vrf HAVING count(s.rt) = 0)", "'GLOBAL'", {"vrf_without_rt_pairs": "p", "vrf_without_rt_count": "n"}),
    "flag_partitions": _rows(f"SELECT {_set('CASE WHEN ssh_present THEN host END')} AS s, {_set('CASE WHEN NOT coalesce(ssh_present, false) THEN host END')} AS m, count(DISTINCT CASE WHEN NOT coalesce(ssh_present, false) THEN host END) AS n, {_set('CASE WHEN aaa_present THEN host END')} AS a, {_set('CASE WHEN NOT coalesce(aaa_present, false) THEN host END')} AS b FROM devices", "'GLOBAL'", {"ssh_enabled_devices": "s", "ssh_missing_devices": "m", "ssh_missing_count": "n", "aaa_enabled_devices": "a", "aaa_missing_devices": "b"}),
    "by_vrf": _rows(f"SELECT v, {_set('host')} AS x FROM (SELECT vrf AS v, ord FROM vrfs UNION SELECT vrf, ord FROM service_vrfs UNION SELECT vrf, ord FROM ({_BOUND})) m JOIN devices d ON d.ord = m.ord GROUP BY v", "v", {"devices_with_same_vrf": "x"}) + " UNION ALL " + _rows(f"SELECT vrf, count(*) AS n FROM ({_BOUND}) GROUP BY vrf", "vrf", {"interfaces_in_vrf": "n"}) + " UNION ALL " + _rows(f"SELECT host || '/' || vrf AS s, count(*) AS n FROM ({_BOUND}) GROUP BY host, vrf", "s", {"vrf_interface_bind_count": "n"}),
    "by_area_and_as": _rows(f"SELECT area, {_set('host')} AS x, count(*) AS n FROM areas a JOIN devices d ON d.ord = a.ord GROUP BY area", "area", {"ospf_area_membership": "x", "ospf_neighbor_count_per_area": "n"}) + " UNION ALL " + _rows(f"SELECT local_as, {_set('host')} AS x FROM devices WHERE local_as IS NOT NULL GROUP BY local_as", "local_as", {"devices_in_as": "x"}),
    "comparisons": _rows(_TWO, "h || '|' || g", {"compare_bgp_neighbor_count": _difference("b1", "b2"), "compare_interface_count": _difference("i1", "i2"), "compare_vrf_count": _difference("v1", "v2"), "compare_bgp_as": "h || ': ' || l1 || ', ' || g || ': ' || l2", "compare_ospf_areas": "h || ': ' || a1 || ', ' || g || ': ' || a2"}),
    "extremes": " UNION ALL ".join(_rows(f"SELECT host || ' (' || {c} || ')' AS x FROM ({_COUNTS}) {w} ORDER BY {c} {o}, ord LIMIT 1", "'GLOBAL'", {k: "x"}) for k, c, w, o in (("max_interface_device", "n_if", "", "DESC"), ("max_bgp_peer_device", "n_bgp", "", "DESC"), ("min_interface_device", "n_if", "WHERE n_if > 0", "ASC"))),
    "summaries": _rows("SELECT coalesce(string_agg(host || ': AS ' || local_as, ', ' ORDER BY ord), '') AS x FROM devices WHERE local_as <> ''", "'GLOBAL'", {"all_devices_same_as": "x"}) + " UNION ALL " + _rows("SELECT coalesce(string_agg(s, ', ' ORDER BY s), '') AS x FROM (SELECT 'AS ' || local_as || ': ' || count(*) AS s FROM devices WHERE local_as <> '' GROUP BY local_as)", "'GLOBAL'", {"bgp_as_distribution": "x"}) + " UNION ALL " + _rows(f"SELECT coalesce(string_agg(host || ': ' || n_vrf, ', ' ORDER BY host || ': ' || n_vrf), '') AS x FROM ({_COUNTS}) WHERE n_vrf > 0", "'GLOBAL'", {"vrf_usage_statistics": "x"}),
}


def sql(group: str) -> str:
    return common_tables("devices", "users", "servers", "interfaces", "neighbors", "vrfs", "service_vrfs", "xconnects", "areas") + _BODY[group]
