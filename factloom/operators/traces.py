"""Reachability over traces, as a solver lists them: a row for each hop of each trace of a flow.

traces(flow_id, trace_no, hop_no, node, disposition, filter, line, action): disposition is that of the whole trace, filter,
line and action tell which rule of an access list the hop met. flows(flow_id, src, dst, src_ip, dst_ip). Everything is a
grouped aggregate on the flow or the trace, so one shuffle on flow_id serves all; lists hold the hops of one flow at most.
Hops with one number are in order of their nodes. A null disposition is neither accepted nor denied, a null node is no
hop; empty tables give no rows; other columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of dispositions, and actions of rules.
ACCEPTED, DENIED, LOST = "ACCEPTED", "DENIED", "DROP|NULL|NO_ROUTE|DENIED"
BLOCKS = ("DENY", "REJECT")


def _accepted() -> Column:
    return F.coalesce(F.contains(F.upper("disposition"), F.lit(ACCEPTED)), F.lit(False))


def _nodes(*order: str) -> Column:
    """Nodes in order, each where it is met first."""
    rows = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct(*order, "node"))))
    return F.array_distinct(F.transform(rows, lambda h: h["node"]))


def paths(traces: DataFrame) -> DataFrame:
    """(flow_id, trace_no, path, n_hops, accepted): path holds each node once, n_hops counts all hops."""
    return traces.groupBy("flow_id", "trace_no").agg(_nodes("hop_no").alias("path"), F.count("node").alias("n_hops"), F.bool_or(_accepted()).alias("accepted"))


def first_paths(traces: DataFrame) -> DataFrame:
    """(flow_id, path, n_hops) of each flow's first trace."""
    first = F.min_by(F.struct("path", "n_hops"), "trace_no")
    return paths(traces).groupBy("flow_id").agg(first.alias("t")).select("flow_id", "t.*")


def reachability(traces: DataFrame) -> DataFrame:
    """(flow_id, reachable, n_traces, nodes): reachable if any trace is accepted; nodes of all traces in order."""
    return traces.groupBy("flow_id").agg(F.bool_or(_accepted()).alias("reachable"), F.count_distinct("trace_no").alias("n_traces"), _nodes("trace_no", "hop_no").alias("nodes"))


def blocking_nodes(traces: DataFrame) -> DataFrame:
    """(flow_id, node): the last hop of each flow's first denied trace."""
    denied = traces.where(F.contains(F.upper("disposition"), F.lit(DENIED)) & F.col("node").isNotNull())
    return denied.groupBy("flow_id").agg(F.max_by("node", F.struct(-F.col("trace_no"), "hop_no", "node")).alias("node"))


def blocking_rules(traces: DataFrame) -> DataFrame:
    """(flow_id, rules): the rules that denied or rejected, as node:filter:Line n, in order of the hops."""
    met = traces.where(F.upper("action").isin(*BLOCKS) & F.col("filter").isNotNull())
    told = met.withColumn("rule", F.concat(F.col("node"), F.lit(":"), F.col("filter"), F.lit(":Line "), F.col("line").cast("string"))).where("rule is not null")
    rows = F.array_sort(F.collect_list(F.struct("trace_no", "hop_no", "rule")))
    return told.groupBy("flow_id").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["rule"])), ", ").alias("rules"))


def loops(traces: DataFrame) -> DataFrame:
    """(flow_id, trace_no, nodes): traces that meet a node again, and these nodes."""
    again = traces.where("node is not null").groupBy("flow_id", "trace_no", "node").agg(F.count("*").alias("n")).where("n > 1")
    return again.groupBy("flow_id", "trace_no").agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("nodes"))


def blackholes(flows: DataFrame, traces: DataFrame) -> DataFrame:
    """(flow_id, n_traces, dispositions): flows that some trace loses, or that have no trace."""
    lost = F.when(F.rlike(F.upper("disposition"), F.lit(LOST)), F.col("disposition"))
    told = traces.groupBy("flow_id").agg(F.count_distinct("trace_no").alias("n_traces"), F.array_join(F.array_sort(F.collect_set(lost)), ", ").alias("dispositions"))
    out = flows.select("flow_id").distinct().join(told, "flow_id", "left").na.fill({"n_traces": 0, "dispositions": ""})
    return out.where("dispositions <> '' or n_traces = 0")


def waypoints(traces: DataFrame, wanted: DataFrame) -> DataFrame:
    """(flow_id, waypoint, passed) for wanted(flow_id, waypoint): whether any trace meets the waypoint, whatever its case."""
    met = traces.select("flow_id", F.lower("node").alias("low")).distinct().withColumn("passed", F.lit(True))
    asked = wanted.select("flow_id", "waypoint", F.lower("waypoint").alias("low"))
    return asked.join(met, ["flow_id", "low"], "left").select("flow_id", "waypoint", F.coalesce("passed", F.lit(False)).alias("passed"))


def policy_violations(flows: DataFrame, traces: DataFrame, dst: str, waypoint: str) -> DataFrame:
    """(flow_id): flows to dst that are reached by a trace past the waypoint."""
    to = flows.where(F.col("dst") == dst).select("flow_id").distinct()
    own = traces.join(to, "flow_id", "left_semi").groupBy("flow_id", "trace_no").agg(F.bool_or(_accepted()).alias("ok"), F.coalesce(F.bool_or(F.lower("node") == waypoint.lower()), F.lit(False)).alias("met"))
    return own.where("ok and not met").select("flow_id").distinct()


def leaks(flows: DataFrame, traces: DataFrame, members: DataFrame) -> DataFrame:
    """(vrf, other, leak): addresses of another VRF that a VRF's addresses reach; members(vrf, ip)."""
    reached = flows.join(reachability(traces).where("reachable").select("flow_id"), "flow_id", "left_semi").select("src_ip", "dst_ip").distinct()
    a, b = members.select("vrf", F.col("ip").alias("src_ip")).distinct(), members.select(F.col("vrf").alias("other"), F.col("ip").alias("dst_ip")).distinct()
    met = reached.join(a, "src_ip").join(b, "dst_ip").where("vrf <> other")
    return met.select("vrf", "other", F.concat("dst_ip", F.lit("/32")).alias("leak")).distinct()


def asymmetric(flows: DataFrame, traces: DataFrame) -> DataFrame:
    """(a, b, there, back, is_symmetric) for a < b with flows in both directions, each by its first flow."""
    first = flows.where("src <> dst").groupBy("src", "dst").agg(F.min("flow_id").alias("flow_id"))
    own = first.join(first_paths(traces), "flow_id").select("src", "dst", "path")
    there, back = own.where("src < dst"), own.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("path").alias("back"))
    both = there.join(back, ["src", "dst"])
    text = lambda c: F.array_join(c, " -> ")
    return both.select(F.col("src").alias("a"), F.col("dst").alias("b"), text("path").alias("there"), text("back").alias("back"), (F.col("path") == F.reverse("back")).alias("is_symmetric"))


def single_points(traces: DataFrame) -> DataFrame:
    """(node, n_flows): nodes between the ends of flows that have one trace alone."""
    alone = paths(traces).groupBy("flow_id").agg(F.count("*").alias("n"), F.any_value("path").alias("path")).where("n = 1 and size(path) > 2")
    return alone.select(F.explode(F.slice("path", 2, F.size("path") - 2)).alias("node")).groupBy("node").agg(F.count("*").alias("n_flows"))


def link_failure(traces: DataFrame, n1: str, n2: str) -> DataFrame:
    """(flow_id, n_traces, n_using, impact) if the link between n1 and n2 fails: no impact, reroute, or outage.

    Two hops in a row use the link if their names hold, or are held in, those of its ends, in either direction and case.
    """
    own = traces.where("node is not null").withColumn("next", F.lead("node").over(Window.partitionBy("flow_id", "trace_no").orderBy("hop_no", "node")))
    alike = lambda c, n: F.contains(F.lower(c), F.lit(n.lower())) | F.contains(F.lit(n.lower()), F.lower(c))
    uses = (alike("node", n1) & alike("next", n2)) | (alike("node", n2) & alike("next", n1))
    each = own.groupBy("flow_id", "trace_no").agg(F.max(F.coalesce(uses, F.lit(False)).cast("long")).alias("uses"))
    out = each.groupBy("flow_id").agg(F.count("*").alias("n_traces"), F.sum("uses").alias("n_using"))
    return out.withColumn("impact", F.when(F.col("n_using") == 0, "no impact").when(F.col("n_using") < F.col("n_traces"), "reroute").otherwise("outage"))


def multiplicity(traces: DataFrame, k: int = 1) -> DataFrame:
    """(flow_id, n_paths, tolerant): the different paths of accepted traces; tolerant if more than k."""
    out = paths(traces).where("accepted").groupBy("flow_id").agg(F.count_distinct("path").alias("n_paths"))
    return out.withColumn("tolerant", F.col("n_paths") > k)


def differential(before: DataFrame, after: DataFrame) -> DataFrame:
    """(flow_id, before, after): flows whose reachability differs between two tables of traces; null where one has no trace."""
    b, a = (reachability(t).select("flow_id", F.col("reachable").alias(n)) for t, n in ((before, "before"), (after, "after")))
    return b.join(a, "flow_id", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("flow_id", "before", "after")


def representative_flows(nodes: DataFrame) -> DataFrame:
    """(src, dst, proto, port, dst_ip) for each pair of nodes(node, ord, ips): TCP to 22 and ICMP, to the second's first address.

    Every pair is asked for, so the result grows with the square of the nodes.
    """
    own = nodes.select("node", "ord", F.get("ips", F.lit(0)).alias("ip"))
    a, b = own.select(F.col("node").alias("src"), F.col("ord").alias("x")), own.where("ip is not null").select(F.col("node").alias("dst"), F.col("ord").alias("y"), F.col("ip").alias("dst_ip"))
    asks = F.array(F.struct(F.lit("TCP").alias("proto"), F.lit(22).alias("port")), F.struct(F.lit("ICMP").alias("proto"), F.lit(None).cast("int").alias("port")))
    return a.join(b, F.col("x") < F.col("y")).select("src", "dst", F.explode(asks).alias("f"), "dst_ip").select("src", "dst", "f.*", "dst_ip")


def mtu_mismatches(edges: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(host, name, other_host, other_name, mtu, other_mtu) of edges(host, name, other_host, other_name); interfaces(host, name, mtu)."""
    own = interfaces.select("host", "name", "mtu")
    far = own.select(F.col("host").alias("other_host"), F.col("name").alias("other_name"), F.col("mtu").alias("other_mtu"))
    return edges.join(own, ["host", "name"]).join(far, ["other_host", "other_name"]).where("mtu <> other_mtu").select("host", "name", "other_host", "other_name", "mtu", "other_mtu")
