"""Reachability operators on small made traces: ties, nulls, repeated nodes, empty tables, clashing names."""

from factloom.operators import traces as tr

SCHEMA = "flow_id long, trace_no int, hop_no int, node string, disposition string, filter string, line int, action string, path string"


def made(spark):
    rows = [
        (1, 0, 1, "ce1", "ACCEPTED", None, None, None, "x"), (1, 0, 2, "pe1", "ACCEPTED", None, None, None, "x"), (1, 0, 3, "CE2", "ACCEPTED", None, None, None, "x"),
        (1, 1, 1, "ce1", "denied_in", None, None, None, "x"), (1, 1, 2, "pe2", "denied_in", "acl9", 4, "Deny", "x"),
        (2, 0, 1, "ce1", None, None, None, None, None), (2, 0, 2, "pe1", None, None, None, None, None), (2, 0, 3, "ce1", None, None, None, None, None), (2, 0, 4, None, None, None, None, None, None),
        (3, 0, 1, "ce2", "NO_ROUTE", None, None, "reject", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_flow(df):
    return {r.flow_id: r for r in df.collect()}


def test_paths_and_reachability(spark):
    t = made(spark)
    first = by_flow(tr.first_paths(t))
    assert first[1].path == ["ce1", "pe1", "CE2"] and first[2].path == ["ce1", "pe1"] and first[2].n_hops == 3
    seen = by_flow(tr.reachability(t))
    assert seen[1].reachable and seen[1].n_traces == 2 and seen[1].nodes == ["ce1", "pe1", "CE2", "pe2"]
    assert not seen[2].reachable and not seen[3].reachable
    assert [(r.flow_id, r.nodes) for r in tr.loops(t).collect()] == [(2, "ce1")]


def test_blocks_and_losses(spark):
    t = made(spark)
    flows = spark.createDataFrame([(i, "a", "b", "1.1", "2.2") for i in (1, 1, 2, 3, 4)], "flow_id long, src string, dst string, src_ip string, dst_ip string")
    assert [(r.flow_id, r.node) for r in tr.blocking_nodes(t).collect()] == [(1, "pe2")]
    assert [(r.flow_id, r.rules) for r in tr.blocking_rules(t).collect()] == [(1, "pe2:acl9:Line 4")]
    lost = {(r.flow_id, r.n_traces, r.dispositions) for r in tr.blackholes(flows, t).collect()}
    assert lost == {(1, 2, "denied_in"), (3, 1, "NO_ROUTE"), (4, 0, "")}
    asked = spark.createDataFrame([(1, "cE2"), (2, "ce2"), (9, "ce1"), (1, None)], "flow_id long, waypoint string")
    assert {(r.flow_id, r.waypoint): r.passed for r in tr.waypoints(t, asked).collect()} == {(1, "cE2"): True, (2, "ce2"): False, (9, "ce1"): False, (1, None): False}
    assert [r.flow_id for r in tr.policy_violations(flows, t, "b", "pe9").collect()] == [1] and tr.policy_violations(flows, t, "b", "PE1").isEmpty()


def test_links_and_changes(spark):
    t = made(spark)
    impact = {r.flow_id: r.impact for r in tr.link_failure(t, "PE1", "ce2").collect()}
    assert impact == {1: "reroute", 2: "no impact", 3: "no impact"}
    assert {r.node: r.n_flows for r in tr.single_points(t).collect()} == {}
    changed = {(r.flow_id, r.before, r.after) for r in tr.differential(t.where("trace_no = 0"), t.where("trace_no = 1")).collect()}
    assert changed == {(1, True, False), (2, False, None), (3, False, None)}
    assert [(r.flow_id, r.n_paths, r.tolerant) for r in tr.multiplicity(t).collect()] == [(1, 1, False)]


def test_empty(spark):
    t = made(spark).limit(0)
    for f in (tr.first_paths, tr.reachability, tr.blocking_nodes, tr.blocking_rules, tr.loops, tr.single_points, tr.multiplicity):
        assert f(t).isEmpty()
