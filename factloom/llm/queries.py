"""The numbered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, fim, huffman, languages, licenses, pii, quality, repeats, secrets, simhash, toxicity
from .common import new_path, read_table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    huffman.write(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path)
    return huffman.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    coded = bpe.round_trip(read_table(spark, sf_dir, "documents"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_huffman_ids": op1_huffman_ids, "op2_pii": op2_pii, "op3_decontaminate": op3_decontaminate, "op4_quality": op4_quality, "op5_bpe": op5_bpe, "op6_toxicity": op6_toxicity, "op7_licenses": op7_licenses, "op8_simhash": op8_simhash, "op9_secrets": op9_secrets, "op10_language": op10_language, "op11_alignment": op11_alignment, "op12_repeats": op12_repeats, "op13_fim": op13_fim}


def oracle_sql() -> dict[str, str]:
    return {"op9_secrets": secrets.digest_sql(), "op13_fim": fim.digest_sql()}
