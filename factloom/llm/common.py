"""Reading, staging and small text helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Python tasks get so many rows and about so many bytes at a time at most: Spark's 10,000 whole texts and their copies can exceed a worker's memory."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("bB")) <= most:
            spark.conf.set(name, str(most))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of any name can't clash; a null text is an empty one."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one beside the warehouse (local sessions only)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read again: cuts the lineage, and lost executors lose nothing of it.

    The shuffle files of the write go when it ends; nothing else reads them.
    """
    spark, path, name = df.sparkSession, new_path(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            delete_path(table.sparkSession, folder)


def free_name(name: str, taken: list[str]) -> str:
    """The name, or one behind underscores that no column has."""
    while name.lower() in {x.lower() for x in taken}:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts, one after the other, and the n + 1 offsets of each text's words."""
    text = text.cast(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    offsets, words = parts.offsets.to_numpy(), parts.values.slice(parts.offsets[0].as_py(), parts.offsets[-1].as_py() - parts.offsets[0].as_py())
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[offsets - offsets[0]]


def strings(a: pa.Array) -> list:
    """The values of a text or binary array as Python objects."""
    return a.to_numpy(zero_copy_only=False).tolist()


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of all texts, and the n + 1 offsets of each text's."""
    n = pc.utf8_length(text).to_numpy()
    return np.frombuffer("".join(strings(text)).encode("utf-32-le", "surrogatepass"), "<u4"), np.concatenate([[0], np.cumsum(n)])


def slices(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about so many bytes of text at a time, one row at least."""
    at = 0
    total = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)))
        yield batch.slice(at, upto - at)
        at = upto


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of a start and a length, one after the other."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = lengths > 0
    s, n = starts[some], lengths[some]
    if len(s):
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        out[at] = s
        out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)
