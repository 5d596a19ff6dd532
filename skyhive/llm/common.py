"""What the operators of this subpackage share: tables in, written steps, words, and packed arrays."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPOSITORY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Environment of Python workers.
WORKERS = {"PYTHONPATH": REPOSITORY, "TOKENIZERS_PARALLELISM": "false", "ARROW_DEFAULT_MEMORY_POOL": "system",
           "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}
_own_folder: list[str] = []  # only where the session names no shared folder, as in tests


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings all operators rely on; safe to call again.

    Shuffle files of a finished write are not needed again, since each step is read back from its table.
    Arrow batches are bounded in rows and bytes, so a batch of long texts fits a Python worker; workers give
    freed arrays back to the system, since several of them share an executor's memory with its JVM.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a step to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*steps: DataFrame) -> None:
    """Delete tables of `stored` that no later step reads."""
    for step in steps:
        spark = step.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Two columns, doc_id and text (null: empty), whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spread(df: DataFrame) -> int:
    """Number of partitions for work on the rows of a table: follows its files, three per core at least."""
    return max(df.rdd.getNumPartitions(), 3 * df.sparkSession.sparkContext.defaultParallelism)


def flushes(batches, limit: int):
    """Arrow batches joined to about `limit` bytes each, where larger ones repeat more of what is done once."""
    held, weight = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            weight += batch.nbytes
            if weight >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: row bounds (n + 1) and the words in a row."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    values, bounds = lists.values, lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(values), 0)  # a leading or trailing gap leaves an empty string
    if pc.all(full).as_py() is False:
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        values, bounds = values.filter(full), before[bounds]
    return bounds - bounds[0], values.slice(0) if bounds[0] == 0 else values


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], ..., starts[i] + lengths[i] - 1 for all i, one after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
