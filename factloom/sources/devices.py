"""Device configurations in XML (two dialects) to the normalized facts tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from factloom.operators.relations import numbered

from .datasets import read_texts
from .staging import staged

#: vrf and encapsulation are read as they stand, since their forms differ.
INTERFACE = "struct<id: string, name: string, vrf: string, `vrf-name`: string, encapsulation: string, shutdown: string, ip: struct<address: struct<primary: struct<address: string, mask: string>>>, ipv4: struct<address: struct<ip: string, mask: string>>>"
#: update-source is read as it stands: its first child's name and text are the value.
PEER = "struct<id: string, `remote-as`: string, `update-source`: string>"
LEVELS = "struct<minor: string, severe: string, critical: string>"
#: One schema for both dialects: absent sections read as null, an empty element as ''. Secrets are not in it, so they are never read.
SCHEMA = """
    name string, address string, port int, ssh struct<`host-key`: string>, `device-type`: struct<cli: struct<`ned-id`: string>, netconf: struct<`ned-id`: string>>,
    config struct<
        admin: struct<aaa: struct<authentication: struct<users: struct<user: array<struct<name: string>>>>>, disk_status_config: LEVELS, memory_status_config: LEVELS, `SNMP-COMMUNITY-MIB`: string, `SNMPv2-MIB`: string>,
        `config-register`: string, hostname: struct<_VALUE: string, _xmlns: string>, version: string, clock: struct<timezone: struct<zone: string>>, logging: struct<buffered: struct<`severity-level`: string>>,
        ip: struct<ssh: struct<version: string>, http: struct<server: string>, cef: string, `cef-conf`: struct<cef: string>, `forward-protocol`: struct<nd: string>>, ssh: struct<server: string>,
        username: array<struct<name: string>>,
        line: struct<vty: array<struct<login: struct<local: string>, transport: struct<input: string>>>>,
        interface: struct<Loopback: array<INTERFACE>, Ethernet: array<INTERFACE>, MgmtEth: array<INTERFACE>, GigabitEthernet: array<INTERFACE>, `GigabitEthernet-subinterface`: struct<GigabitEthernet: array<INTERFACE>>>,
        vrf: struct<`vrf-list`: array<struct<name: string, `address-family`: struct<ipv4: struct<unicast: struct<
            import: struct<`route-target`: struct<`address-list`: array<struct<name: string>>>>, export: struct<`route-target`: struct<`address-list`: array<struct<name: string>>>>>>>>>>,
        l2vpn: struct<xconnect: struct<`group`: array<struct<p2p: array<struct<interface: struct<name: string>, neighbor: struct<address: string, `pw-id`: string>>>>>>>,
        mpls: struct<ldp: struct<interface: array<struct<name: string>>>>,
        router: struct<_xmlns: string,
            ospf: array<struct<name: string, area: array<struct<id: string, interface: array<struct<name: string>>>>>>,
            bgp: struct<`as-no`: string, neighbor: array<PEER>,
                `bgp-no-instance`: struct<id: string, neighbor: array<PEER>,
                    vrf: array<struct<name: string, rd: string, neighbor: array<PEER>>>>>>>
""".replace("PEER", PEER).replace("INTERFACE", INTERFACE).replace("LEVELS", LEVELS)


def dense(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ord: 0, 1, 2, ... in the order of these columns, without a gap and without putting whole rows in order."""
    staged_rows = staged(rows, "rows")
    places = numbered(staged_rows.select(*order).withColumn("one", F.lit(1)), "one", order)
    return staged_rows.join(places.select(*order, (F.col("place") - 1).cast("long").alias("ord")), order)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(ord, file, device): a row for each device element, ord without gaps by file name and place in the file. Files that aren't XML give no rows.

    Configurations are parsed once and written; names and places alone are put in order, by counts of ranges.
    """
    rows = spark.read.format("xml").options(rowTag="device", ignoreNamespace=True, mode="PERMISSIVE", pathGlobFilter="*.xml").schema(StructType.fromDDL(SCHEMA)).load(path)
    named = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("d"))
    return dense(named.where("d.name IS NOT NULL OR d.config IS NOT NULL"), ["file", "at"]).select("file", "d", "ord")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of the files that read() finds no device in."""
    found = read(spark, path).select("file").distinct()
    return read_texts(spark, path, recursive=False).select("file").join(found, "file", "left_anti").withColumn("error", F.lit("no device element"))


def ssh_in_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, ssh_in_text): whether the file's text as it stands speaks of SSH in the manner of command lines."""
    told = F.rlike("text", F.lit(r"(?is)\bip\s+ssh\b|line\s+vty.*transport\s+input\s+ssh"))
    return read_texts(spark, path, recursive=False).select("file", told.alias("ssh_in_text"))


def _list(c: Column, like: str) -> Column:
    return F.coalesce(c, F.array().cast(like))


def tables(devices: DataFrame, told: DataFrame | None = None) -> dict[str, DataFrame]:
    """The facts tables of factloom.plans.facts from read()'s rows; with ssh_in_text()'s rows, those count for SSH too.

    Areas without interfaces and processes without areas have a row with nulls. Neither dialect's schema has servers: that table is empty.
    """
    if told is None:
        told = devices.select("file", F.lit(False).alias("ssh_in_text")).limit(0)
    devices = devices.join(told.groupBy("file").agg(F.bool_or("ssh_in_text").alias("ssh_in_text")), "file", "left")
    c = lambda path: F.col(f"d.config.{path}")
    d = devices.withColumn("host", F.coalesce(F.nullif(F.trim(F.coalesce("d.config.hostname._VALUE", "d.name")), F.lit("")), F.col("file")))
    bgp = "router.bgp.`bgp-no-instance`"
    local_as = F.coalesce(c(f"{bgp}.id"), c("router.bgp.`as-no`"))

    def interfaces() -> DataFrame:
        like = "array<struct<name:string,ipv4:string,vrf:string,status:string,vlan:string>>"

        def rows(kind: str, path: str) -> Column:
            def row(i: Column) -> Column:
                ip = F.coalesce(i["ip"]["address"]["primary"]["address"], i["ipv4"]["address"]["ip"])
                mask = F.coalesce(i["ip"]["address"]["primary"]["mask"], i["ipv4"]["address"]["mask"])
                named = F.nullif(F.regexp_extract(i["vrf"], r"<(?:\w+:)?name\b[^>]*>\s*([^<]*?)\s*<", 1), F.lit(""))
                plain = F.when(~F.contains(i["vrf"], F.lit("<")), i["vrf"])
                vlan = F.nullif(F.regexp_extract(i["encapsulation"], r"vlan-id\b[^>]*>\s*([^<]*?)\s*<", 1), F.lit(""))
                return F.struct(
                    F.concat(F.lit(kind), F.coalesce(i["id"], i["name"], F.lit(""))).alias("name"), F.coalesce(F.concat(ip, F.lit("/"), F.nullif(mask, F.lit(""))), ip).alias("ipv4"),
                    F.coalesce(named, i["vrf-name"], plain).alias("vrf"), F.when(i["shutdown"].isNotNull(), "down").otherwise("up").alias("status"), vlan.alias("vlan"),
                )

            return _list(F.transform(c(f"interface.{path}"), row), like)

        kinds = [rows(kind, kind) for kind in ("Loopback", "Ethernet", "MgmtEth", "GigabitEthernet")]
        return d.select("ord", F.posexplode(F.concat(*kinds, rows("GigabitEthernet", "`GigabitEthernet-subinterface`.GigabitEthernet"))).alias("no", "i")).select("ord", F.col("no").cast("long"), "i.*")

    ifs = interfaces()
    loop = ifs.where(F.lower("name").startswith("loopback") & F.col("ipv4").isNotNull()).groupBy("ord").agg(F.min_by("ipv4", "no").alias("ip")).select("ord", F.split_part("ip", F.lit("/"), F.lit(1)).alias("loopback"))
    vty = F.get(c("line.vty"), 0)
    ned = F.lower(F.coalesce("d.device-type.cli.ned-id", "d.device-type.netconf.ned-id", F.lit("")))
    space = lambda path: F.coalesce(c(f"{path}._xmlns"), F.lit(""))
    xr_router = c("router").isNotNull() & (F.contains(space("router"), F.lit("xr")) | c(bgp).isNotNull())
    ios_host = c("hostname").isNotNull() & ~F.contains(space("hostname"), F.lit("xr"))
    vendor = F.when(F.contains(ned, F.lit("ios-xr")) | xr_router, "ios-xr").when(F.contains(ned, F.lit("ios-cli")) | ios_host, "ios").otherwise("ios-xr")
    base = d.select(
        "ord", "file", "host", vendor.alias("vendor"),
        c("logging.buffered.severity-level").alias("log_severity"), F.when(vty["login"]["local"].isNotNull(), "local").alias("vty_login"), vty["transport"]["input"].alias("vty_transport"), c("version").alias("version"), c("clock.timezone.zone").alias("timezone"),
        (c("ssh").isNotNull() | F.col("d.ssh").isNotNull() | F.coalesce(F.col("d.port") == 22, F.lit(False)) | c("ip.ssh").isNotNull() | F.coalesce("ssh_in_text", F.lit(False))).alias("ssh_present"), c("ip.ssh.version").alias("ssh_version"),
        F.lit(None).cast("string").alias("aaa_method"), c("admin.aaa").isNotNull().alias("aaa_present"), (F.size(_list(c("mpls.ldp.interface"), "array<struct<name:string>>")) > 0).alias("ldp_enabled"), F.lit(None).cast("string").alias("ldp_router"), local_as.alias("local_as"),
        F.col("d.address").alias("mgmt_address"), F.col("d.port").alias("mgmt_port"), c("`config-register`").alias("config_register"), (F.lower(c("ip.http.server")) == "true").alias("http_enabled"),
        c("ip.`forward-protocol`.nd").isNotNull().alias("forward_protocol_nd"), (c("ip.cef").isNotNull() | c("ip.`cef-conf`.cef").isNotNull()).alias("cef_enabled"), (c("admin.`SNMP-COMMUNITY-MIB`").isNotNull() | c("admin.`SNMPv2-MIB`").isNotNull()).alias("snmp_present"),
        *[c(f"admin.{part}_status_config.{level}").try_cast("int").alias(f"{part}_{level}") for part in ("disk", "memory") for level in ("minor", "severe", "critical")],
    ).join(loop, "ord", "left")

    peer = "array<struct<vrf:string,peer:string,remote_as:string,update_source:string>>"
    first_child = lambda x: F.nullif(F.concat(*[F.regexp_extract(x, r"<(?:[\w-]+:)?([\w-]+)\b[^>]*?/?>\s*([^<]*?)\s*(?:<|$)", i) for i in (1, 2)]), F.lit(""))
    of = lambda a, vrf: _list(F.transform(a, lambda n: F.struct(vrf.alias("vrf"), n["id"].alias("peer"), n["remote-as"].alias("remote_as"), first_child(n["update-source"]).alias("update_source"))), peer)
    none = F.lit(None).cast("string")
    vrf_peers = _list(F.flatten(F.transform(c(f"{bgp}.vrf"), lambda v: of(v["neighbor"], v["name"]))), peer)
    neighbors = d.select("ord", F.explode(F.concat(of(c(f"{bgp}.neighbor"), none), of(c("router.bgp.neighbor"), none), vrf_peers)).alias("n")).select("ord", "n.*")

    targets = lambda v, side: _list(F.transform(v["address-family"]["ipv4"]["unicast"][side]["route-target"]["address-list"], lambda t: t["name"]), "array<string>")
    defined = d.select("ord", F.posexplode(c("vrf.vrf-list")).alias("no", "v")).select("ord", F.col("v.name").alias("vrf"), "no", targets(F.col("v"), "import").alias("i"), targets(F.col("v"), "export").alias("e"))
    first = defined.withColumn("k", F.row_number().over(Window.partitionBy("ord", "vrf").orderBy("no"))).where("k = 1")
    vrfs = d.select("ord", F.explode(c(f"{bgp}.vrf")).alias("v")).select("ord", F.col("v.name").alias("vrf"), F.col("v.rd").alias("rd")).join(first, ["ord", "vrf"], "left").select("ord", "vrf", "rd", F.size(_list(F.col("i"), "array<string>")).alias("n_import"), F.size(_list(F.col("e"), "array<string>")).alias("n_export"))
    services = defined.select("ord", "vrf", F.explode_outer(F.array_distinct(F.concat("i", "e"))).alias("rt"))

    p2p = F.flatten(F.transform(c("l2vpn.xconnect.`group`"), lambda g: g["p2p"]))
    xconnects = d.select("ord", F.posexplode(p2p).alias("no", "x")).select("ord", F.col("no").cast("long"), F.col("x.neighbor.address").alias("neighbor"), F.col("x.neighbor.pw-id").alias("pw"))
    process = d.select("ord", F.explode(c("router.ospf")).alias("p")).select("ord", F.col("p.name").alias("pid"), F.explode_outer("p.area").alias("a"))
    areas = process.select("ord", F.col("a.id").alias("area"), F.explode_outer("a.interface").alias("i"), "pid").select("ord", "area", F.col("i.name").alias("interface"), "pid")
    named = lambda a: _list(F.transform(a, lambda u: u["name"]), "array<string>")
    users = d.select("ord", F.explode(F.concat(named(c("admin.aaa.authentication.users.user")), named(c("username")))).alias("name"))
    servers = d.limit(0).select("ord", F.lit("").alias("kind"), F.lit("").alias("value"))
    return {"devices": base, "users": users, "servers": servers, "interfaces": ifs, "neighbors": neighbors, "vrfs": vrfs, "service_vrfs": services, "xconnects": xconnects, "areas": areas}
