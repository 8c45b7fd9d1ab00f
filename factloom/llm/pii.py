"""Personal data: base patterns, and contextual extraction bootstrapped from what they find. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .spans import matches, rendered

KINDS = ("email", "ip", "card", "phone")
#: What can be personal data, and what must hold of it. Possessive and anchored forms of the plain
#: patterns: they match the same, and take time in proportion to the text whatever it holds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without any of these holds no match.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Groups of digits between blanks, or else a word with a digit or an at sign: what contexts may discover.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?:\(?[0-9]++[0-9().-]*+(?:\x20\(?[0-9]++[0-9().-]*+)++|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Rounds of induction and scoring; seeds that a pattern needs; trust in a pattern and in an instance that is new;
#: trusted patterns that it needs, or the trust of one that is enough alone.
ROUNDS, LEAST_SEEDS, LEAST_TRUST, LEAST_PATTERNS, ALONE = 3, 4, 0.85, 2, 0.9
#: Seeds that count against a pattern before it has met any other instance.
DOUBT = 0.5

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """For digits alone: whether their checksum is right."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return F.when(~twice, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda part: F.rlike(part, F.lit("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _context(m: Column) -> tuple[Column, Column, Column]:
    """The two words before a match, the one before, and the one after, in lower case; empty beside another match."""
    before, after = F.lower(F.right(m["before"], F.lit(120))), F.lower(F.left(m["after"], F.lit(60)))
    one = F.regexp_extract(before, r"([^\s]+)\s*$", 1)
    two = F.regexp_replace(F.regexp_extract(before, r"([^\s]+\s+[^\s]+)\s*$", 1), r"\s+", " ")
    return two, one, F.regexp_extract(after, r"^[^\s\w]*\s*([^\s]+)", 1)


def _found(text: Column, kind: str, rank: int) -> Column:
    """array<struct<start, rank, end, kind, value, two, one, next>> of a kind's matches that hold."""

    def row(m: Column) -> Column:
        two, one, following = _context(m)
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lower(m["value"]).alias("value"), two.alias("two"), one.alias("one"), following.alias("next"))

    return F.transform(F.filter(matches(text, PATTERNS[kind] if kind in PATTERNS else CANDIDATE), lambda m: _holds(kind, m["value"])), row)


_ROW = "array<struct<start:int,rank:int,end:int,kind:string,value:string,two:string,one:string,next:string>>"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, base and other: the base matches of each row's text, and other words with digits or an at sign."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_ROW)
    base = []
    for rank, kind in enumerate(KINDS):
        gate = text.contains(GATES[kind]) if GATES[kind] else F.rlike(text, F.lit("[0-9]"))
        base.append(F.when(gate, _found(text, kind, rank)).otherwise(none))
    other = F.when(F.rlike(text, F.lit("[0-9@]")), _found(text, "other", len(KINDS))).otherwise(none)
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.concat(*base).alias("base"), other.alias("other"))
    free = F.filter("other", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return found.select("doc_id", "row_no", "base", free.alias("other"))


def _plausible(value: Column) -> Column:
    """The kinds that a new instance's form allows."""
    n = F.length(_digits(value))
    return F.array_compact(
        F.array(
            F.when(value.contains("@") & F.rlike(value, F.lit(r"[a-z0-9]@[a-z0-9]")), "email"),
            F.when(F.rlike(value, F.lit(r"^[^\w]*([0-9a-f]{0,4}:){3,7}[0-9a-f]{0,4}[^\w]*$")) | F.rlike(value, F.lit(r"^[^\w]*[0-9]{1,3}(\.[0-9]{1,3}){3}[^\w]*$")), "ip"),
            F.when((n >= 12) & F.rlike(value, F.lit(r"^[^\w]*[0-9*x\x20-]+[^\w]*$")), "card"),
            F.when(n.between(7, 15) & F.rlike(value, F.lit(r"^[^\w]*[0-9().\x20-]+[^\w]*$")) & F.rlike(value, F.lit(r"[0-9][().\x20-]+[0-9]")), "phone"),
        )
    )


def _patterns(o: Column) -> Column:
    """The lexical patterns that a place offers: the two words before, the one before, and the words on both sides."""
    two = F.when(F.contains(o["two"], F.lit(" ")), F.concat(F.lit("< "), o["two"]))
    one = F.when(o["one"] != "", F.concat(F.lit("- "), o["one"]))
    sides = F.when((o["one"] != "") & (o["next"] != ""), F.concat(F.lit("= "), o["one"], F.lit(" _ "), o["next"]))
    return F.array_compact(F.array(two, one, sides))


def discover(found: DataFrame) -> DataFrame:
    """(value, kind) of new instances that trusted patterns lead to, bootstrapped from the base matches.

    Places give a graph of patterns and instances, each pair once. In each round the seeds, base matches and what was
    accepted before, induce the patterns that LEAST_SEEDS of them of one kind share. A pattern's trust in a kind is the
    share of its instances that are seeds of it (with DOUBT against it); a new instance's score in a kind that its form
    allows is the mean of its patterns' trust; patterns then gain what their instances scored, and instances that
    enough trusted patterns lead to are accepted: they are seeds of the next round. All steps are joins and sums of
    rows; a pattern or an instance met everywhere is one row for each other end.
    """
    place = lambda o, seed: F.struct(seed.alias("seed"), o["value"].alias("value"), _patterns(o).alias("ps"))
    places = F.concat(F.transform("base", lambda o: place(o, o["kind"])), F.transform("other", lambda o: place(o, F.lit(None).cast("string"))))
    rows = found.select(F.explode(places).alias("o"))
    edges = staged(rows.select("o.seed", "o.value", F.explode("o.ps").alias("pattern")).distinct(), "graph")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"), F.count("seed").alias("seeds"))
    # what never can be trusted, even if all that could be new were seeds, needs no row
    open_ = edges.where("seed is null").select("value", "pattern", F.explode(_plausible(F.col("value"))).alias("kind"))
    apt = open_.groupBy("pattern", "kind").agg(F.count("*").alias("apt")).select("pattern", "kind", "apt")
    sure = edges.where("seed is not null").select("pattern", F.col("seed").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").alias("sure"))
    able = apt.join(sure, ["pattern", "kind"], "left").join(sizes, "pattern").select("pattern", "kind", F.coalesce("sure", F.lit(0)).alias("sure"), "size", "apt")
    able = staged(able.where((F.col("sure") + F.col("apt") >= LEAST_SEEDS) & (F.col("sure") + F.col("apt") >= LEAST_TRUST * (F.col("size") + DOUBT))), "patterns")
    new = staged(open_.join(able, ["pattern", "kind"]).select("value", "pattern", "kind", "sure", "size"), "new")
    accepted = new.limit(0).select("value", "kind")
    for _ in range(ROUNDS):
        taken = new.join(accepted.withColumn("seed", F.lit(1)), ["value", "kind"], "left").withColumn("seed", F.coalesce("seed", F.lit(0)))
        taken = staged(taken, "taken")
        seeds = taken.groupBy("pattern", "kind").agg((F.first("sure") + F.sum("seed")).alias("seeds"), F.first("size").alias("size")).where(F.col("seeds") >= LEAST_SEEDS)
        seeds = staged(seeds, "induced")
        trust = seeds.select("pattern", "kind", (F.col("seeds") / (F.col("size") + DOUBT)).alias("trust"))
        fresh = taken.where("seed = 0").select("value", "pattern", "kind")
        scored = fresh.join(trust, ["pattern", "kind"]).groupBy("value", "kind").agg(F.avg("trust").alias("score"))
        gained = fresh.join(scored, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
        trust = staged(seeds.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("size") + DOUBT)).alias("trust")), "trust")
        scored = new.join(trust, ["pattern", "kind"]).groupBy("value", "kind").agg(F.avg("trust").alias("score"), F.count_if(F.col("trust") >= LEAST_TRUST).alias("n"), F.max("trust").alias("best"))
        enough = (F.col("score") >= LEAST_TRUST) & ((F.col("n") >= LEAST_PATTERNS) | (F.col("best") >= ALONE))
        best = scored.where(enough).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        accepted = staged(best.union(accepted.join(best, "value", "left_anti").select("value", "kind")), "accepted")
    return accepted


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, spans array<struct<start, rank, end, kind>>) for every row of docs, base ranks 0 to 3, new ones 4 to 7.

    New instances keep the name of their kind with a leading "ctx_". Nulls are empty texts; repeated rows and rows
    without doc_id are searched as any other; an empty table gives no rows.
    """
    found = staged(occurrences(docs.select("doc_id", "text")), "places")
    accepted = staged(discover(found), "accepted")
    places = found.select("row_no", F.explode("other").alias("o")).select("row_no", "o.value", "o.start", "o.end")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") + len(KINDS) - 1
    span = F.struct("start", rank.alias("rank"), "end", F.concat(F.lit("ctx_"), "kind").alias("kind"))
    new = places.join(accepted, "value").groupBy("row_no").agg(F.collect_list(span).alias("new"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    joined = found.select("doc_id", "row_no", base.alias("base")).join(new, "row_no", "left")
    return joined.select("doc_id", "row_no", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(f"array<{_SPAN}>")))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = scan(docs)
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.sha2(rendered(F.filter("spans", lambda s: s["rank"] < len(KINDS))), 256)
    return found.select("doc_id", *[n(k) for k in range(len(KINDS))], base.alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
