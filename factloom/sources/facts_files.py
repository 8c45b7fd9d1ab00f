"""Facts as JSON: documents of devices to the facts tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .datasets import read_texts
from .devices import dense
from .staging import staged

_PEERS = "array<struct<id: string, ip: string, remote_as: string, update_source: string>>"
#: A device's document; secrets aren't in it.
DOCUMENT = f"""struct<
    vendor: string, system: struct<hostname: string, mgmt_address: string, version: string, timezone: string, config_register: string, users: array<struct<name: string>>>,
    security: struct<ssh: struct<present: boolean, version: string>, aaa: struct<present: boolean, method: string>, http: struct<server_enabled: boolean>>,
    interfaces: array<struct<name: string, ipv4: string, vlan: string, vrf: string, status: string>>, num_interfaces: int,
    routing: struct<bgp: struct<local_as: string, neighbors: {_PEERS}, vrfs: array<struct<name: string, rd: string, neighbors: {_PEERS}, rt_import: array<string>, rt_export: array<string>, undefined: boolean>>>, ospf: struct<process_ids: array<string>, areas: map<string, array<string>>>>,
    services: struct<vrf: array<struct<name: string, rd: string, route_targets: array<string>>>, l2vpn: array<struct<neighbor: string, pw_id: string>>, mpls: struct<ldp_interfaces: array<string>, ldp_router_id: string>>,
    logging: struct<buffered_severity: string>, line: struct<vty: struct<login_mode: string, transport_input: string>>, servers: array<struct<kind: string, value: string>>, file: string, error: string>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(ord, file, d): a row for each device of the JSON files under path, in order of file name and place, ord without gaps.

    A file is an object with devices, a list of devices, or a device a line. Text that isn't JSON gives no rows, nor do
    entries that aren't objects, or that tell of an error instead of a device.
    """
    texts = read_texts(spark, path, "*.json").select("file", "text", F.try_parse_json("text").alias("v"))
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    whole = F.coalesce(F.try_variant_get("v", "$.devices", "array<variant>"), as_list(F.col("v")))
    several = texts.where(whole.isNotNull()).select("file", F.posexplode(whole).alias("at", "one")).select("file", "at", F.to_json("one").alias("json"))
    lines = texts.where(whole.isNull()).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "json"))
    rows = several.union(lines).select("file", "at", F.from_json("json", DOCUMENT).alias("d"))
    return dense(rows.where("d IS NOT NULL AND d.error IS NULL AND coalesce(d.system.hostname, d.file) IS NOT NULL"), ["file", "at"]).select("ord", "file", "d")


def _list(c: Column, like: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(like))


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The facts tables of read_documents()'s rows; a device's file is the one that its document names, else the one it is in."""
    d = documents
    c = lambda path: F.col(f"d.{path}")
    explode = lambda path: d.select("ord", F.posexplode(c(path)).alias("no", "x"))
    ifs = explode("interfaces").select("ord", F.col("no").cast("long"), "x.name", "x.ipv4", "x.vrf", F.coalesce("x.status", F.lit(None)).alias("status"), "x.vlan")
    loop = ifs.where(F.lower("name").startswith("loopback") & (F.col("ipv4") != "")).groupBy("ord").agg(F.min_by("ipv4", "no").alias("ip")).select("ord", F.split_part("ip", F.lit("/"), F.lit(1)).alias("loopback"))
    devices = d.select(
        "ord", F.coalesce(c("file"), F.col("file")).alias("file"), F.coalesce(F.nullif(c("system.hostname"), F.lit("")), c("file"), F.col("file")).alias("host"), c("vendor").alias("vendor"), c("logging.buffered_severity").alias("log_severity"),
        c("line.vty.login_mode").alias("vty_login"), c("line.vty.transport_input").alias("vty_transport"), c("system.version").alias("version"), c("system.timezone").alias("timezone"), c("security.ssh.present").alias("ssh_present"), c("security.ssh.version").alias("ssh_version"),
        c("security.aaa.method").alias("aaa_method"), c("security.aaa.present").alias("aaa_present"), (F.size(_list(c("services.mpls.ldp_interfaces"))) > 0).alias("ldp_enabled"), c("services.mpls.ldp_router_id").alias("ldp_router"), c("routing.bgp.local_as").alias("local_as"),
        c("system.mgmt_address").alias("mgmt_address"), c("system.config_register").alias("config_register"), c("security.http.server_enabled").alias("http_enabled"),
    ).join(loop, "ord", "left")
    peer = lambda vrf, n: F.struct(vrf.cast("string").alias("vrf"), F.coalesce(n["id"], n["ip"]).alias("peer"), n["remote_as"].alias("remote_as"), n["update_source"].alias("update_source"))
    like = "array<struct<vrf: string, peer: string, remote_as: string, update_source: string>>"
    inside = F.flatten(F.transform(_list(c("routing.bgp.vrfs"), DOCUMENT.split("vrfs: ")[1].split(">>, ospf")[0] + ">"), lambda v: _list(F.transform(v["neighbors"], lambda n: peer(v["name"], n)), like)))
    neighbors = d.select("ord", F.explode(F.concat(_list(F.transform(c("routing.bgp.neighbors"), lambda n: peer(F.lit(None), n)), like), inside)).alias("n")).select("ord", "n.*")
    vrfs = explode("routing.bgp.vrfs").where("NOT coalesce(x.undefined, false)").select("ord", F.col("x.name").alias("vrf"), "x.rd", F.size(_list(F.col("x.rt_import"))).alias("n_import"), F.size(_list(F.col("x.rt_export"))).alias("n_export"))
    services = explode("services.vrf").select("ord", F.col("x.name").alias("vrf"), F.explode_outer(F.array_distinct("x.route_targets")).alias("rt"))
    xconnects = explode("services.l2vpn").select("ord", F.col("no").cast("long"), "x.neighbor", F.col("x.pw_id").alias("pw"))
    pid = F.get(c("routing.ospf.process_ids"), 0)
    areas = d.select("ord", pid.alias("pid"), F.explode(c("routing.ospf.areas")).alias("area", "of")).select("ord", "area", F.explode_outer("of").alias("interface"), "pid")
    bare = d.where(pid.isNotNull() & (F.size(F.map_keys(c("routing.ospf.areas"))) <= 0)).select("ord", F.lit(None).cast("string"), F.lit(None).cast("string"), pid)
    users = explode("system.users").select("ord", "x.name")
    return {"devices": devices, "users": users, "servers": explode("servers").select("ord", "x.kind", "x.value"), "interfaces": ifs, "neighbors": neighbors, "vrfs": vrfs, "service_vrfs": services, "xconnects": xconnects, "areas": areas.union(bare)}


def staged_tables(found: DataFrame) -> dict[str, DataFrame]:
    """tables() of documents that are costly to make: these are made three times in all, not for each use of each table.

    A device's neighbors and pseudowires may be very many; they are written as rows, and the rest of the documents
    without them, so that no reader holds a batch of long lists.
    """
    t = tables(found)
    none = F.lit(None)
    short = F.col("d").withField("routing.bgp.neighbors", none.cast(_PEERS)).withField("services.l2vpn", none.cast("array<struct<neighbor: string, pw_id: string>>"))
    short = short.withField("routing.bgp.vrfs", F.transform("d.routing.bgp.vrfs", lambda v: v.withField("neighbors", none.cast(_PEERS))))
    rest = tables(staged(found.withColumn("d", short), "documents"))
    return rest | {name: staged(t[name], name) for name in ("neighbors", "xconnects")}


def documents(t: dict[str, DataFrame]) -> DataFrame:
    """(ord, d): the facts tables as a document for each device, as DOCUMENT says; lists hold one device's rows. Import and export targets are counted in the tables, so documents have as many unnamed ones; a VRF that only neighbors name is marked undefined."""

    def gathered(rows: DataFrame, name: str, row: Column, order: str | None = None) -> DataFrame:
        kept = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))) if order else F.array_sort(F.collect_list(row))
        return rows.groupBy("ord").agg((F.transform(kept, lambda x: x["r"]) if order else kept).alias(name))

    text = F.lit(None).cast("string")
    col = lambda df, name: F.col(name) if name in df.columns else text
    peer = F.struct(F.col("peer").alias("id"), text.alias("ip"), F.col("remote_as"), col(t["neighbors"], "update_source").alias("update_source"))
    inner = t["neighbors"].where("vrf IS NOT NULL").groupBy("ord", "vrf").agg(F.array_sort(F.collect_list(peer)).alias("neighbors"))
    some = lambda n: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: i.cast("string"))
    first = F.row_number().over(Window.partitionBy("ord", "vrf").orderBy("rd", "n_import", "n_export"))
    bgp_vrfs = t["vrfs"].select("ord", "vrf", "rd", "n_import", "n_export", first.alias("k")).join(inner.withColumn("k", F.lit(1)), ["ord", "vrf", "k"], "full_outer").withColumn("undefined", F.col("n_import").isNull())
    services = t["service_vrfs"].groupBy("ord", "vrf").agg(F.array_sort(F.collect_set("rt")).alias("rts"))
    areas = t["areas"].where("area IS NOT NULL").groupBy("ord", "area").agg(F.array_sort(F.collect_list("interface")).alias("of"))
    d = t["devices"]
    for rows, name, row, order in (
        (t["users"], "users", F.struct("name"), None), (t["servers"], "servers", F.struct("kind", "value"), None),
        (t["interfaces"], "interfaces", F.struct("name", "ipv4", col(t["interfaces"], "vlan").alias("vlan"), "vrf", "status"), "no"), (t["neighbors"].where("vrf IS NULL"), "peers", peer, None),
        (bgp_vrfs, "bgp_vrfs", F.struct(F.col("vrf").alias("name"), "rd", "neighbors", some("n_import").alias("rt_import"), some("n_export").alias("rt_export"), "undefined"), None),
        (services, "services", F.struct(F.col("vrf").alias("name"), text.alias("rd"), F.col("rts").alias("route_targets")), None), (t["xconnects"], "l2vpn", F.struct("neighbor", F.col("pw").alias("pw_id")), "no"),
    ):
        d = d.join(gathered(rows, name, row, order), "ord", "left")
    d = d.join(areas.groupBy("ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("area", "of")))).alias("areas")), "ord", "left")
    d = d.join(t["areas"].groupBy("ord").agg(F.array_sort(F.collect_set("pid")).alias("pids")), "ord", "left")
    s = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    f = lambda name: col(d, name)
    ldp = F.when(F.col("ldp_enabled"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    document = s(
        vendor=f("vendor"), system=s(hostname=f("host"), mgmt_address=f("mgmt_address"), version=f("version"), timezone=f("timezone"), config_register=f("config_register"), users=f("users")),
        security=s(ssh=s(present=f("ssh_present"), version=f("ssh_version")), aaa=s(present=f("aaa_present"), method=f("aaa_method")), http=s(server_enabled=f("http_enabled").cast("boolean"))), interfaces=f("interfaces"), num_interfaces=F.size(_list(f("interfaces"), "array<struct<name: string, ipv4: string, vlan: string, vrf: string, status: string>>")),
        routing=s(bgp=s(local_as=f("local_as"), neighbors=f("peers"), vrfs=f("bgp_vrfs")), ospf=s(process_ids=f("pids"), areas=f("areas"))), services=s(vrf=f("services"), l2vpn=f("l2vpn"), mpls=s(ldp_interfaces=ldp, ldp_router_id=f("ldp_router"))),
        logging=s(buffered_severity=f("log_severity")), line=s(vty=s(login_mode=f("vty_login"), transport_input=f("vty_transport"))), servers=f("servers"), file=f("file"), error=text,
    )
    return d.select("ord", document.cast(DOCUMENT).alias("d"))


def write_documents(t: dict[str, DataFrame], path: str) -> None:
    """A device a line, in files by ranges of the devices' order."""
    documents(t).repartitionByRange("ord").sortWithinPartitions("ord").select("d.*").write.json(path)


def write_tables(t: dict[str, DataFrame], path: str) -> None:
    """Each facts table as Parquet in a folder of its name."""
    for name, rows in t.items():
        rows.write.parquet(f"{path}/{name}")
