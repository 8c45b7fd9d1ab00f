"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, staged, strings, texts, unstaged, words_of
from .components import connected_components

#: Parts of a fingerprint; each table of variants leaves one of them out.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def text_fingerprint(words: list[bytes], shingle_words: int = 3) -> int:
    """The 64-bit fingerprint of one sequence of words."""
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle_words, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    over = 2 * np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = words_of(batch["text"])
            words = strings(words.cast(pa.large_binary()))
            fps = [text_fingerprint(words[s:e], shingle_words) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _kept(fp: Column, block: int) -> Column:
    """fp without a block, packed, with the block's number on top."""
    low, width = BLOCKS[block]
    below = fp.bitwiseAND(F.lit((1 << low) - 1))
    above = F.shiftleft(F.shiftrightunsigned(fp, low + width), low) if low + width < 64 else F.lit(0).cast("long")
    return below.bitwiseOR(above).bitwiseOR(F.lit(block << 60))


def _block(fp: Column, key: Column) -> Column:
    """The block that the key leaves out."""
    part = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in BLOCKS]
    n = F.shiftrightunsigned(key, 60)
    return F.when(n == 0, part[0]).when(n == 1, part[1]).otherwise(part[2])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fp: Column, block: int) -> Column:
    """All keys within one bit of fp's, the block left out."""
    low, width = BLOCKS[block]
    flips = [0] + [_signed(1 << i) for i in range(64) if not low <= i < low + width]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: _kept(fp.bitwiseXOR(x), block))


def links(fps: DataFrame, one_part: bool = True) -> DataFrame:
    """Edges (a, b) that connect exactly what pairs of fingerprints (fp long) within three bits connect.

    Meet in the middle: of two fingerprints within three bits, some part can be left out so that the rest differs in
    two bits or fewer (see below), and then both are within one bit of a common middle. So every distinct fingerprint
    emits, for each of three parts left out, its rest and all variants of it by one bit (131 rows); equal variants meet
    in one shuffle. Members of one variant with the same left-out part are within two bits of each other: a star to the
    least of them connects them all. Left-out parts that differ in one bit are within three: their least members are
    linked. Left over are pairs with all their bits in one part, whose rests are equal: where such fingerprints aren't
    connected yet, two-bit and one-bit variants of that part alone meet. No pair within a group is ever listed, so a
    variant met by very many fingerprints costs no more than its rows; every edge is verified. Without one_part that
    last step is left out.
    """
    fps = fps.select("fp").where("fp is not null").distinct()
    met = fps.select("fp", F.explode(F.concat(*[_variants(F.col("fp"), b) for b in range(3)])).alias("key")).repartition("key")
    met = met.withColumn("part", _block(F.col("fp"), F.col("key")))
    met = met.withColumn("least", F.first("fp").over(Window.partitionBy("key", "part").orderBy("fp")))
    by_key = Window.partitionBy("key").orderBy("part", "fp")
    met = met.withColumn("more", F.lag("fp").over(by_key).isNotNull() | F.lead("fp").over(by_key).isNotNull())
    met = staged(met.where("more").drop("more"), "met")
    stars = met.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    one = Window.partitionBy("key").orderBy("part")
    several = met.where("fp = least").withColumn("several", F.lag("part").over(one).isNotNull() | F.lead("part").over(one).isNotNull()).where("several")
    bit = F.explode(F.sequence(F.lit(0), F.lit(21)))
    crossed = (
        several.select("key", "part", "fp", bit.alias("bit"))
        .withColumn("cleared", F.expr("part & ~shiftleft(1L, bit)"))
        .groupBy("key", "bit", "cleared")
        .agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        .select("a", "b")
    )
    close = "a <> b and bit_count(a ^ b) <= 3"
    near = stars.union(crossed).where(close).distinct()
    if not one_part:
        return near
    near = staged(near, "near")
    parts = fps.join(connected_components(near).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return near.union(_in_one_part(parts).where(close)).distinct()


def _in_one_part(fps: DataFrame) -> DataFrame:
    """Edges between fingerprints (fp, component) that differ in one part alone and aren't connected yet."""
    exact = fps.select("fp", "component", F.explode(F.array(*[_kept(F.col("fp"), b) for b in range(3)])).alias("key"))
    apart = exact.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    near = exact.join(apart, "key").withColumn("part", _block(F.col("fp"), F.col("key")))
    width = max(w for _, w in BLOCKS)
    ball = [(0, 0)] + [(1 << i, 1) for i in range(width)] + [(1 << i | 1 << j, 2) for i in range(width) for j in range(i)]
    flips = F.array(*[F.struct(F.lit(x).cast("long").alias("flip"), F.lit(n).alias("bits")) for x, n in ball])
    met = near.select("key", "fp", "part", F.explode(flips).alias("v")).select("key", "fp", F.col("v.bits").alias("bits"), F.col("part").bitwiseXOR(F.col("v.flip")).alias("middle"))
    least = F.min(F.when(F.col("bits") <= 1, F.col("fp"))).over(Window.partitionBy("key", "middle"))
    return met.withColumn("a", least).where("a is not null").select("a", F.col("fp").alias("b"))


def components(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that links of three bits or fewer reach, itself included. A text without words
    has fingerprint zero and links as any other; a null text is an empty one; repeated rows stay; a row without a
    doc_id gets its class's component, null if no member has an id. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle_words), "prints")
    firsts = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    found = connected_components(links(firsts))
    named = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = staged(named.join(ids, "component").select("fp", "component_id"), "named")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chained(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each start."""
    h = np.full(len(starts), k, np.uint64)
    for i in range(k):
        h = _mixed(h + np.uint64(0x9E3779B97F4A7C15)) ^ words[starts + i]
    return _mixed(h)


#: Parts of the hashes' range that a set's shingles are counted in.
PARTS = 256
#: Numbers that hold a bit for each part.
MARKS = PARTS // 64


def _shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, key, sid, fp, shingles, parts, marks): the sorted hashes of the distinct shingles of each row with an id and words, their hash, their SimHash, how many lie in each part of the range, and the parities of these counts, 64 to a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = words_of(batch["text"])
            coded = words.dictionary_encode()
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in strings(coded.dictionary.cast(pa.large_binary()))], np.uint64)
            words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
            full = _chained(words, np.arange(max(0, len(words) - shingle_words + 1)), shingle_words)
            kept, sids, fps, found, parts = [], [], [], [], []
            for row, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if s < e:
                    own = full[s : e - shingle_words + 1] if e - s >= shingle_words else _chained(words, np.array([s]), e - s)
                    own = np.unique(own.view(np.int64))
                    found.append(own)
                    kept.append(row)
                    sids.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                    parts.append(np.bincount(own.view(np.uint64) >> np.uint64(56), minlength=PARTS).astype(np.int32))
                    fps.append(np.packbits(2 * np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) > len(own)))
            long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * PARTS, pa.int32()), pa.array(flat))
            marks = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * MARKS, pa.int32()), long(np.packbits((flat & 1).astype(np.uint8).reshape(-1, 64), axis=1)))
            columns = [batch["doc_id"].take(pa.array(kept, pa.int64())), batch["key"].take(pa.array(kept, pa.int64())), long(np.array(sids, np.uint64)), long(np.array(fps, np.uint8).reshape(-1, 8)), lists, counts, marks]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "sid", "fp", "shingles", "parts", "marks"])

    return texts(docs).where("doc_id is not null").withColumn("key", _row_key()).mapInArrow(run, "doc_id long, key long, sid long, fp long, shingles array<long>, parts array<int>, marks array<long>")


#: A shingle that more prefixes hold goes to the end of the order; so many such shingles are sent to the tasks at most.
OFTEN, MOST_OFTEN = 64, 500_000

#: Rounds before all that are still apart are tested, and members of a shingle's group that each round draws to test the others against.
ROUNDS, DRAWN = 2, 32


def _prefixes(sets: DataFrame, similarity: float, often: dict[int, int], entered: bool = False) -> DataFrame:
    """(token, sid, size, place): of each set the first shingles in the order (how often, hash) that any similar set must share one of.

    Of a set of n, a similar one holds at least similarity * n; so not all of the first n - ceil(similarity * n) + 1 can
    be missing from it, and of two similar sets the first common shingle is in both prefixes. With entered, only those
    shingles that would not be in the prefix if all were equally often.
    """
    tokens = np.array(sorted(often), np.int64)
    levels = np.array([often[x] for x in tokens.tolist()], np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["shingles"]
            offsets = lists.offsets.to_numpy()
            sizes, flat = np.diff(offsets), lists.values.to_numpy()[offsets[0] : offsets[-1]]
            level = np.zeros(len(flat), np.int8)
            if len(tokens):
                spot = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
                level = np.where(tokens[spot] == flat, levels[spot], 0)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, level, row))
            place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            first = place < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[row]
            if entered:  # hashes come sorted, so the plain prefix is the one by position
                first &= ~first[order]
            row = row[first]
            sids = batch["sid"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][first]), pa.array(sids[row]), pa.array(sizes[row].astype(np.int32)), pa.array(place[first].astype(np.int32))], ["token", "sid", "size", "place"])

    return sets.select("sid", "shingles").mapInArrow(run, "token long, sid long, size int, place int")


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda s, v: s + v)


def _apart(x: str, y: str) -> Column:
    """Shingles that one of two sets holds alone, at least: a part whose counts differ in parity has one. Short enough to travel with each row of a shingle's group."""
    return reduce(Column.__add__, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(MARKS)])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sids whose sets reach the similarity.

    Two sets share no more than the lesser count of each part of the hashes' range, summed: by that bound most pairs go
    before any shingles are sent. It never drops a pair that reaches the similarity.
    """
    pairs = staged(pairs.distinct(), "pairs")

    def both(pairs: DataFrame, own: DataFrame, column: str) -> DataFrame:
        x, y = (own.select(F.col("sid").alias(end), F.col(column).alias(c)) for end, c in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b")

    def reached(shared: Column, size_x: Column, size_y: Column) -> Column:
        return shared >= F.lit(similarity) * (size_x + size_y - shared)

    bound = _total(F.zip_with("x", "y", lambda p, q: F.least(p, q)))
    likely = staged(both(pairs, sets, "parts").where(reached(bound, _total(F.col("x")), _total(F.col("y")))).select("a", "b"), "likely")
    ends = likely.select(F.col("a").alias("sid")).union(likely.select("b")).distinct()
    needed = staged(sets.select("sid", "shingles").join(ends, "sid", "left_semi"), "needed")
    shared = F.size(F.array_intersect("x", "y"))
    out = staged(both(likely, needed, "shingles").where(reached(shared, F.size("x"), F.size("y"))).select("a", "b"), "similar")
    unstaged(pairs, likely, needed)
    return out


def close_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of sids: sets whose fingerprints are equal or linked by ball hashing, and that reach the similarity."""
    classes = staged(sets.groupBy("fp").agg(F.min("sid").alias("least")), "classes")
    same = sets.select("sid", "fp").join(classes, "fp").where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    end = lambda c: classes.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_sid"))
    across = links(classes, one_part=False).join(end("a"), "a").join(end("b"), "b").select(F.least("a_sid", "b_sid").alias("a"), F.greatest("a_sid", "b_sid").alias("b"))
    return _similar(same.union(across), sets, similarity)


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect exactly what pairs of sets (sid, fp, shingles) of that similarity or more connect.

    Fingerprints within three bits are linked first, by ball hashing, and each link verified. Sets of similarity 0.8
    differ in ten bits on average, so most pairs of different texts lie beyond any radius that a ball can have; an exact
    way finds the rest, whatever their bits: sets whose prefixes share a shingle meet, rare shingles first, since often
    met ones go to the end of the order. Of two sets the smaller can be met in its shorter prefix only: both together
    hold fewer shingles than it needs to share with an equal or larger one. Each set is tested against the one most like
    it, by marks, of some that are drawn from its shingles' groups, in ROUNDS rounds and each time of others; then those
    of components that are still apart against each other. Pairs within one component need no test, so a large group of
    near copies is never listed by pairs.
    """
    often: dict[int, int] = {}
    for entered in (False, True):
        met = _prefixes(sets, similarity, often, entered).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN)
        top = met.orderBy(F.desc("n"), "token").limit(MOST_OFTEN).toArrow()
        new = {t: n.bit_length() for t, n in zip(top["token"].to_pylist(), top["n"].to_pylist()) if t not in often}
        room = MOST_OFTEN - len(often)
        often.update(list(new.items())[:room])
        if not new or room <= len(new):
            break
    several = staged(_prefixes(sets, similarity, often).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "several")
    rows = staged(_prefixes(sets, similarity, often).join(several, "token"), "met")
    unstaged(several)
    edges = close_links(sets, similarity)
    share = similarity / (1 + similarity)
    one = F.struct("size", "sid", "place", "component", "marks")
    short = F.col("place") < F.col("size") - F.ceil(F.lit(2 * share) * F.col("size") - F.lit(1e-6)) + 1

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows of shingles that different components hold, one of them in its shorter prefix."""
        components = connected_components(edges)
        named = components.withColumnRenamed("node", "sid")
        members = rows.select("token", "sid", "size", "place").join(named, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        apart = members.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(short).alias("some")).where("low <> high and some").select("token")
        found = staged(members.join(apart, "token"), "open")
        unstaged(components, rows)
        return found

    def candidates(met: DataFrame) -> DataFrame:
        """Pairs of the structs x and y; no more can be shared than what follows the first common shingle, itself included, and what the marks tell apart is shared by neither."""
        both = F.col("x.size") + F.col("y.size")
        most = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
        size = lambda end: F.col(f"{end}.size")
        found = met.where(F.col("x.component") != F.col("y.component"))
        found = found.where((most + 1e-6 >= F.lit(share) * both) & (F.least(size("x"), size("y")) + 1e-6 >= F.lit(similarity) * F.greatest(size("x"), size("y"))))
        found = found.where((both - _apart("x.marks", "y.marks")) / 2 + 1e-6 >= F.lit(share) * both)
        return found.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), _apart("x.marks", "y.marks").alias("apart"))

    before_y = "(x.size < y.size or (x.size = y.size and x.sid < y.sid))"
    for turn in range(ROUNDS + 1):
        rows = labelled(rows)
        if rows.isEmpty():
            break
        marked = rows.join(sets.select("sid", "marks"), "sid")
        ys = marked.select("token", one.alias("y"), short.alias("y_short"))
        if turn < ROUNDS:
            drawn = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("x.sid", F.lit(turn))))
            xs = marked.select("token", one.alias("x"), short.alias("x_short")).withColumn("k", drawn).where(F.col("k") <= DRAWN)
            pairs = candidates(xs.join(ys, "token").where(F.expr(f"if({before_y}, x_short, y_short)"))).groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
        else:
            pairs = candidates(marked.where(short).select("token", one.alias("x")).join(ys, "token").where(before_y))
        found = _similar(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets, similarity)
        before, edges = edges, staged(edges.union(found), "edges")
        unstaged(before, found)
    unstaged(rows)
    return edges


def _row_key() -> Column:
    """Tells apart rows of one doc_id: rows of the same id and text are copies."""
    return F.xxhash64("text").alias("key")


def _grouped(docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(doc_id, key, first): for each row with an id and words, first is the least (doc_id, key) of its near copies."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = staged(_shingle_sets(keyed, shingle_words).select("doc_id", "key", "sid"), "prints")
    firsts = staged(prints.groupBy("sid").agg(F.min(F.struct("doc_id", "key")).alias("first")), "firsts")
    own = keyed.withColumn("key", _row_key()).join(firsts.select("first.doc_id", "first.key"), ["doc_id", "key"], "left_semi").drop("key")
    sets = staged(_shingle_sets(own, shingle_words).select("sid", "fp", "shingles", "parts", "marks"), "sets")
    edges = similar_links(sets, similarity)
    found = connected_components(edges)
    unstaged(sets, edges)
    named = firsts.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    ids = named.groupBy("component").agg(F.min("first").alias("least"))
    by_sid = staged(named.join(ids, "component").select("sid", "least"), "named")
    return prints.join(by_sid, "sid").select("doc_id", "key", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) for each row of docs with an id and words: group_id is the smallest doc_id of its near copies.

    Near copies are documents whose distinct shingles of shingle_words words reach the similarity (shared over all), and
    what such pairs connect; every pair counts. Texts without words and rows without doc_id are in no group; rows of one
    doc_id are grouped by their own texts, repeated rows are in the same group; an empty table gives no rows.
    """
    return _grouped(docs, shingle_words, similarity).select("doc_id", F.col("first.doc_id").alias("group_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays, of rows with one id and text a single one.

    Rows are told apart by id and text, so different texts under one doc_id are judged each on its own. Rows without
    doc_id or without words stay.
    """
    key, mine = free_name("row_key", docs.columns), F.struct("doc_id", "key")
    groups = staged(_grouped(docs, 5, 0.8), "groups")
    named = lambda rows: rows.select("doc_id", F.col("key").alias(key))
    gone = named(groups.where(mine != F.col("first")).select("doc_id", "key").distinct())
    kept = docs.withColumn(key, _row_key()).join(gone, ["doc_id", key], "left_anti")
    twice = named(staged(groups.where(mine == F.col("first")).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key"), "twice"))
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twice, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return kept.join(twice, ["doc_id", key], "left_anti").select(*docs.columns).union(once.select(*docs.columns))
