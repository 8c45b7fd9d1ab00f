"""Dense retrieval over a stated set of queries, and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import vector_index


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, query_label, vec_id, label, score, rank): the k nearest others of each query, ties by vec_id. A vector of length zero is 0 alike to all."""
    found = vector_index.exact(vectors, queries.select(F.col("vec_id").alias("query_id"), "embedding"), k)
    labels = vectors.select("vec_id", "label")
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(labels, "vec_id").join(own, "query_id").select("query_id", "query_label", "vec_id", "label", "score", "rank")


def recall_and_mrr(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """For each k-list: recall, whether any hit, reciprocal rank of the first; averaged over queries; recall over those with anything to find."""
    hit = F.col("label") == F.col("query_label")
    each = ranked.where(F.col("rank") <= k).groupBy("query_id", "query_label").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    joined = each.join(totals, F.col("query_label") == F.col("label"))
    return joined.agg(F.count("*").alias("n"), F.round(F.avg(F.try_divide(F.col("hits"), F.col("total"))), 6).alias("recall"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
