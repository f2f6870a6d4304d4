"""Tables and files that jobs share: all below the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset, a local master, as in tests, gets a temporary folder; on a
    cluster, whose executors couldn't see it, that is an error."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set(SETTING, base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, folder: str, name: str) -> None:
    """Deletes a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, folder: str, name: str, rows: int = 0) -> DataFrame:
    """Writes a table and gives it back as a scan: the lineage ends there, and what is lost is read again. `rows` is the most that a file
    has, if not 0: readers take a page of a file whole, which a few large values fill together."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marks a written table of fixed-width rows for a broadcast join if it has at most so many; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which the worker gives freed memory back: workers are used again, and idle ones count too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run
