"""Answers about two scopes at once, scopes of pairs and interfaces, and what technologies devices use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import falsy
from factloom.operators.relations import sampled_share

Tables = dict[str, DataFrame]


def compared_answers(answers: DataFrame, asks: DataFrame) -> DataFrame:
    """(ask, answer_type, answer, error) for asks(ask, kind, metric, scopes array, operator): whether the answers of the first two scopes are equal (==) or not (!=).

    An ask needs a metric, two scopes and an operator, else INVALID_COMPARISON; another kind than comparison is
    UNKNOWN_KIND. Another operator is never true. Scopes without an answer are alike to each other and unlike any answer.
    """
    text = lambda i: F.get("scopes", F.lit(i))
    rows = asks.select("ask", "kind", "metric", "operator", F.size(F.coalesce("scopes", F.array().cast("array<string>"))).alias("n"), text(0).alias("a"), text(1).alias("b"))
    for end in "ab":
        rows = rows.join(answers.select("metric", F.col("scope").alias(end), F.col("answer").alias(f"{end}_answer")), ["metric", end], "left")
    same = F.col("a_answer").eqNullSafe(F.col("b_answer"))
    told = F.when(F.col("operator") == "==", same).when(F.col("operator") == "!=", ~same).otherwise(False)
    short = falsy(F.col("metric")) | falsy(F.col("operator")) | (F.col("n") < 2)
    error = F.when(~F.coalesce(F.col("kind") == "comparison", F.lit(False)), "UNKNOWN_KIND").when(short, "INVALID_COMPARISON")
    return rows.select("ask", F.when(error.isNull(), "boolean").otherwise("error").alias("answer_type"), F.when(error.isNull(), told.cast("string")).alias("answer"), error.alias("error"))


def linked_pairs(t: Tables, edges: DataFrame) -> DataFrame:
    """(scope_type, scope, keys): pairs of devices that edges(src, dst) of their ord link, each once, as first|second by ord."""
    d = t["devices"].select("ord", "host")
    pairs = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("src <> dst").distinct()
    named = pairs.join(d.select(F.col("ord").alias("x"), F.col("host").alias("host_a")), "x").join(d.select(F.col("ord").alias("y"), F.col("host").alias("host_b")), "y")
    keys = F.map_from_arrays(F.array(F.lit("host"), F.lit("other")), F.array("host_a", "host_b"))
    return named.select(F.lit("DEVICE_PAIR").alias("scope_type"), F.concat_ws("|", "host_a", "host_b").alias("scope"), keys.alias("keys"))


def interface_scopes(t: Tables) -> DataFrame:
    """(scope_type, scope, keys): every interface with a name, as host/name, each once."""
    own = t["interfaces"].where(~falsy(F.col("name"))).join(t["devices"].select("ord", "host"), "ord").select("host", F.col("name").alias("interface")).distinct()
    keys = F.map_from_arrays(F.array(F.lit("host"), F.lit("if")), F.array("host", "interface"))
    return own.select(F.lit("INTERFACE").alias("scope_type"), F.concat_ws("/", "host", "interface").alias("scope"), keys.alias("keys"))


def with_sampled_devices(templates: DataFrame, scopes: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Templates times the scopes of their type; those of level L1 that ask devices meet a seeded sample of max(1, n * ratio) devices alone."""
    devices = F.col("scope_type") == "DEVICE"
    sample = sampled_share(scopes.where(devices), ["scope"], ratio, seed)
    first = F.coalesce((F.col("level") == "L1") & devices, F.lit(False))
    return templates.where(~first).join(scopes, "scope_type").unionByName(templates.where(first).join(sample, "scope_type"))


def technologies(t: Tables) -> DataFrame:
    """(host, bgp, ospf, vrf, l2vpn, mpls, ssh, aaa): what each device uses."""
    out = t["devices"].select("ord", "host", (~falsy(F.col("local_as"))).alias("own_as"), F.coalesce("ldp_enabled", F.lit(False)).alias("mpls"), F.coalesce("ssh_present", F.lit(False)).alias("ssh"), F.coalesce("aaa_present", F.lit(False)).alias("aaa"))
    for name, rows in (("peers", t["neighbors"]), ("ospf", t["areas"]), ("l2vpn", t["xconnects"]), ("vrf", t["vrfs"].select("ord").union(t["service_vrfs"].select("ord")))):
        out = out.join(rows.select("ord").distinct().withColumn(name, F.lit(True)), "ord", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    return out.select("host", (F.col("own_as") | on("peers")).alias("bgp"), on("ospf").alias("ospf"), on("vrf").alias("vrf"), on("l2vpn").alias("l2vpn"), "mpls", "ssh", "aaa")


def listed(answers: DataFrame) -> DataFrame:
    """(metric, n_items): different items in all comma lists of each metric's answers."""
    items = answers.select("metric", F.explode(F.split("answer", ", ")).alias("item")).where("item <> ''")
    return items.groupBy("metric").agg(F.count_distinct("item").alias("n_items"))
