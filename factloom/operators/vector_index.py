"""Nearest vectors: exact search in tiles of matrix products, and an inverted file of cells with over-fetch, exact rescoring and fallback."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.sources.staging import new_path, staged

#: Vectors the cells are fitted on at most, cells at most, and rows of either side in a tile.
SAMPLE_ROWS, CELLS_MOST, TILE_ROWS, TILE_QUERIES = 20_000, 4_096, 8_192, 1_024
#: Candidates that are fetched for each one that is kept, and digits of a score.
OVER_FETCH, DIGITS = 3, 6

CODES = "cell int, vec_id long, scale float, code binary"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of an array<float> column; null vectors and values are zero."""
    rows = vectors.to_pylist()
    size = max((len(r) for r in rows if r is not None), default=0)
    out = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        if r is not None:
            out[i, : len(r)] = [x or 0.0 for x in r]
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


@dataclass
class Index:
    """centers: one unit-length row for each cell; cells: (cell, rows); codes: CODES, one row for each vector, in files by cell."""

    centers: np.ndarray
    cells: DataFrame
    codes: DataFrame


def fit(vectors: DataFrame, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Centers of cells by k-means over at most SAMPLE_ROWS vectors, chosen by a hash of their id; about the root of their number of cells.

    Vectors of length zero take no part; without any other there is one cell at zero.
    """
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    some = vectors.where(length > 0)
    sample = staged(some.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE_ROWS).select(F.transform("embedding", lambda x: x / length).alias("unit")), "sample")
    n = some.count()
    if not n:
        return np.zeros((1, 1))
    k = min(cells or int(np.ceil(np.sqrt(n))), CELLS_MOST, sample.count())
    if k <= 1:
        return _unit(np.array([sample.agg(F.array(*[F.avg(F.get("unit", F.lit(i))) for i in range(len(sample.first().unit))])).first()[0]]))
    model = KMeans(k=k, seed=seed, maxIter=10, initMode="random").fit(sample.select(array_to_vector("unit").alias("features")))
    return _unit(np.array(model.clusterCenters()))


def build(vectors: DataFrame, centers: np.ndarray) -> Index:
    """Every vector's code in its nearest cell: what it differs from the center by, each value in a byte, with one scale for each vector.

    Codes are written by cell, so a search of few cells reads few files. Centers are bounded by CELLS_MOST and sent to
    the tasks; vectors of length zero are in the first cell and alike to nothing.
    """
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(centers)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _padded(_unit(_matrix(batch["embedding"])), sent.value.shape[1])
            cell = (unit @ sent.value.T).argmax(1) if len(unit) else np.zeros(0, np.int64)
            zero = ~unit.any(1)
            cell[zero] = 0
            rest = unit - np.where(zero[:, None], 0, sent.value[cell])
            scale = np.abs(rest).max(1) / 127
            code = np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0).round().astype(np.int8)
            scale[zero] = -1  # marks a vector of length zero
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch["vec_id"], pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "vec_id", "scale", "code"])

    path = new_path(spark, "codes")
    made = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(coded, CODES)
    made.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.partitionBy("cell").parquet(path)
    codes = spark.read.schema(CODES).parquet(path)
    return Index(centers, staged(codes.groupBy("cell").agg(F.count("*").alias("rows")), "cells"), codes)


def _padded(m: np.ndarray, size: int) -> np.ndarray:
    return m[:, :size] if m.shape[1] >= size else np.pad(m, ((0, 0), (0, size - m.shape[1])))


def _tiled(rows: DataFrame, queries: DataFrame, cells: DataFrame, score, keep: int) -> DataFrame:
    """(query_id, vec_id, score): of each cell that a query asks, its best candidates.

    Both sides of a cell are dealt to tiles of bounded size, so a cell with a third of all vectors, or one that a third
    of all queries ask, is many tasks; each tile is one matrix product and gives back keep rows for each of its queries.
    """
    asked = queries.groupBy("cell").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("sides"))
    tiles = cells.select("cell", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("parts")).join(asked, "cell")
    part, side = F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.pmod(F.xxhash64("query_id"), F.col("sides"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.join(tiles, "cell").withColumn("part", part.cast("int")).withColumn("side", every(F.col("sides"))).drop("parts", "sides")
    right = queries.join(tiles, "cell").withColumn("side", side.cast("int")).withColumn("part", every(F.col("parts"))).drop("parts", "sides")

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, asked = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        found = np.round(score(vectors, queries), DIGITS)
        found[asked[:, None] == ids[None, :]] = -np.inf
        out = []
        for q, line in enumerate(found):
            kept = np.flatnonzero(line >= np.partition(line, -keep)[-keep]) if len(line) > keep else np.arange(len(line))
            kept = kept[np.lexsort((ids[kept], -line[kept]))][:keep]
            kept = kept[line[kept] > -np.inf]
            out.append((np.full(len(kept), asked[q]), ids[kept], line[kept]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*out)))))

    keys = ["cell", "part", "side"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def _first(rows: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)


def rescored(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k of the candidates (query_id, vec_id) by exact cosine, ties by vec_id; a vector of length zero is 0 alike to all."""
    side = lambda df, key, name: df.select(F.col("vec_id" if key == "vec_id" else "query_id").alias(key), F.col("embedding").alias(name))
    met = candidates.select("query_id", "vec_id").distinct().join(side(vectors, "vec_id", "v"), "vec_id").join(side(queries, "query_id", "q"), "query_id")
    length = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q")))
    score = F.round(F.coalesce(F.try_divide(dot(F.col("v"), F.col("q")), length), F.lit(0.0)), DIGITS)
    return _first(met.select("query_id", "vec_id", score.alias("score")), k)


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest others of each query(query_id, embedding) among all vectors.

    All rows are one cell, dealt to tiles: matrix products, no nested loop, and nothing sent whole to all tasks. Ids are
    taken as distinct; a vector with the query's own id is left out.
    """
    rows = vectors.select(F.lit(0).alias("cell"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(F.lit(0).alias("cell"), F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("wanted"))
    cells = rows.groupBy("cell").agg(F.count("*").alias("rows"))

    def score(vectors: pa.Table, queries: pa.Table) -> np.ndarray:
        v, q = _unit(_matrix(vectors["embedding"].combine_chunks())), _unit(_matrix(queries["wanted"].combine_chunks()))
        size = max(v.shape[1], q.shape[1])
        return _padded(q, size) @ _padded(v, size).T

    found = _first(_tiled(rows, asked, cells, score, OVER_FETCH * k), OVER_FETCH * k)
    return rescored(found, vectors, queries, k)


def _probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, cell, wanted): each query at the cells whose centers are nearest; never more than there are."""
    sent = queries.sparkSession.sparkContext.broadcast(index.centers)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _padded(_unit(_matrix(batch["embedding"])), sent.value.shape[1])
            n = min(probes, len(sent.value))
            cells = np.argsort(-(unit @ sent.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(rows), pa.array(cells.ravel()), batch["embedding"].take(rows)], ["query_id", "cell", "wanted"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(near, "query_id long, cell int, wanted array<double>")


def candidates(index: Index, queries: DataFrame, probes: int, keep: int) -> DataFrame:
    """(query_id, vec_id, score): the best of the probed cells by their codes."""
    centers = index.centers

    def score(vectors: pa.Table, queries: pa.Table) -> np.ndarray:
        code = np.frombuffer(b"".join(vectors["code"].to_pylist()), np.int8).reshape(vectors.num_rows, -1).astype(np.float32)
        scale = vectors["scale"].to_numpy()
        q = _padded(_unit(_matrix(queries["wanted"].combine_chunks())), centers.shape[1])
        found = (q @ code.T) * np.maximum(scale, 0) + (q @ centers[vectors["cell"][0].as_py()])[:, None]
        found[:, scale < 0] = 0
        return found

    return _first(_tiled(index.codes, _probed(index, queries, probes), index.cells, score, keep), keep)


def probes_for(index: Index, vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.95, sample: int = 100, seed: int = 42) -> int:
    """How many cells a query has to probe so that on average the share least of its k true neighbours lies in them, by a seeded sample of at most that many queries.

    True neighbours come from exact search; each has the rank that its cell takes among the query's cells, and the
    answer is the smallest number of cells that holds enough of them.
    """
    some = staged(queries.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(sample), "sample")
    truth = exact(vectors, some, k).select("query_id", "vec_id")
    order = Window.partitionBy("query_id").orderBy("at")
    ranked = _probed(index, some, len(index.centers)).select("query_id", "cell", F.monotonically_increasing_id().alias("at")).withColumn("place", F.row_number().over(order))
    met = truth.join(index.codes.select("vec_id", "cell"), "vec_id").join(ranked, ["query_id", "cell"])
    counts = {r.place: r.n for r in met.groupBy("place").agg(F.count("*").alias("n")).collect()}  # a row for each cell at most
    found, total = 0, sum(counts.values())
    for place in range(1, len(index.centers) + 1):
        found += counts.get(place, 0)
        if found >= least * total:
            return place
    return len(index.centers)


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int, probes: int = 8, fallback: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): about the k nearest others of queries(query_id, embedding), with exact scores.

    OVER_FETCH times k candidates come from the cells that a query probes, by join on the cell; they are scored exactly
    and cut to k. Queries that found fewer than k are asked again, first by their embedding in fallback(query_id,
    embedding), if there is one, then in all cells; so each has k answers wherever there are k other vectors.
    """
    keep = OVER_FETCH * k
    found = staged(candidates(index, queries, probes, keep), "candidates")
    short = lambda rows: queries.join(rows.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    if fallback is not None:
        again = fallback.join(short(found).select("query_id"), "query_id", "left_semi")
        found = staged(found.union(candidates(index, again, probes, keep)), "candidates")
    rest = short(found)
    if not rest.isEmpty():
        found = staged(found.join(rest.select("query_id"), "query_id", "left_anti").union(candidates(index, rest, len(index.centers), keep)), "candidates")
    return rescored(found, vectors, queries, k)


def retrieve(index: Index, vectors: DataFrame, queries: DataFrame, fetch_n: int, keep_n: int, rerank: DataFrame | None = None, probes: int = 8) -> DataFrame:
    """(query_id, vec_id, score, rank): fetch_n nearest, of which keep_n stay: the best by rerank(query_id, vec_id, score), if it is given, else the nearest.

    Candidates that rerank doesn't score come after those it does, in the order of their nearness.
    """
    found = search(index, vectors, queries, fetch_n, probes)
    if rerank is None:
        return found.where(F.col("rank") <= keep_n)
    given = rerank.select("query_id", "vec_id", F.col("score").alias("given"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("given"), "rank")
    ranked = found.join(given, ["query_id", "vec_id"], "left").withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("place") <= keep_n).select("query_id", "vec_id", F.coalesce("given", "score").alias("score"), F.col("place").alias("rank"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's true neighbours that were found."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
