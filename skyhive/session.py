"""Session settings the operators rely on, and where intermediate tables may be written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


_private_root: list[str] = []  # only used where the cluster names no shared folder


def prepare(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC. Generated methods above 8,000 bytes are never compiled by the JVM and run
    an order of magnitude slower, so stages that large use the smaller per-operator methods instead.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where none is named (tests)."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _private_root:
        _private_root.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _private_root[0]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for one intermediate or output table."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write once to the shared folder and read from there.

    For results used more than once: they are worked out a single time, later readers take only the columns
    they need, the planner knows the size, and the loss of an executor costs nothing.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, *steps: Callable) -> list:
    """What the steps return, in order. For steps that do not read each other: each is a chain of small jobs, and while one
    waits for the driver or its last task, the cores work for the other.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [step.result() for step in begun]
