"""Detectors one by one, each with a time limit, and results kept by what went in.

A detector's job runs under a job group of its own, which is cancelled when its time is up; its tasks are isolated by Spark. Completed
results lie as Parquet below a folder, named by a hash of the tables, the detector and the settings, and are taken from there
the next time; a write that didn't finish has no success mark and counts for nothing.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analyze as plan

LIMIT = 300.0


@dataclass
class Run:
    detector: str
    status: str  # completed, reused, timed_out, failed or skipped
    reason: str
    flags: DataFrame | None
    elapsed_seconds: float
    limit_seconds: float


def content_key(tables: DataFrame, detector: str, settings: dict) -> str:
    """A hash of all tables in any order, the detector and its settings."""
    row = F.sha2(F.to_json(F.struct("table_id", "metric", "entity", "lower_is_better", "axes", F.transform("cells", lambda c: F.struct(c["row_id"], F.to_json(F.array_sort(F.map_entries(c["coords"]))).alias("at"), c["value"], c["raw"])).alias("cells"))), 256)
    # The sum of parts of the rows' hashes doesn't depend on their order.
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    text = F.concat_ws("/", F.count("*").cast("string"), *parts, F.lit(detector), F.lit(repr(sorted(settings.items()))))
    return tables.agg(F.sha2(text, 256).alias("k")).first()["k"]


def _finished(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def limited(spark: SparkSession, job, seconds: float) -> str:
    """Runs a job under a group that is cancelled after some seconds: 'completed', 'timed_out', or the error."""
    group = uuid.uuid4().hex
    out: list[str] = []

    def work() -> None:
        spark.sparkContext.setJobGroup(group, "bounded detector", interruptOnCancel=True)
        try:
            job()
            out.append("completed")
        except Exception as e:  # noqa: BLE001  the run's record says what happened
            out.append(f"{type(e).__name__}: {str(e)[:300]}")

    thread = threading.Thread(target=inheritable_thread_target(spark)(work), daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        # What a detector starts after this still belongs to the group, so it is cancelled again until the thread ends.
        for _ in range(100):
            spark.sparkContext.cancelJobGroup(group)
            thread.join(0.1)
            if not thread.is_alive():
                break
        return "timed_out"
    return out[0]


def run_bounded(tables: DataFrame, folder: str, seconds: float = 4.0, only: list[str] | None = None, expected: dict[str, str] | None = None, expect_flat: tuple[str, ...] = ()) -> list[Run]:
    """A run a detector, in order. `folder` is shared by all executors. Tables beyond the gate are skipped by all detectors."""
    if not 0 < seconds <= LIMIT:
        raise ValueError(f"a limit must lie above 0 and within {LIMIT:g} seconds")
    seconds = float(seconds)
    spark = tables.sparkSession
    context = plan.context(tables, expected, expect_flat)
    settings = {"expected": sorted((expected or {}).items()), "flat": sorted(expect_flat)}
    runs = []
    for name, detector in plan.DETECTORS.items():
        if only is not None and name not in only:
            continue
        if context.series.isEmpty():
            runs.append(Run(name, "skipped", "no series within the limits on axes and combinations", None, 0.0, seconds))
            continue
        path = f"{folder.rstrip('/')}/{content_key(tables, name, settings)}"
        began = time.monotonic()
        if _finished(spark, path):
            runs.append(Run(name, "reused", "", spark.read.parquet(path), time.monotonic() - began, seconds))
            continue
        said = limited(spark, lambda detector=detector, path=path: detector(context).write.mode("overwrite").parquet(path), seconds)
        took = time.monotonic() - began
        if said == "completed":
            runs.append(Run(name, said, "", spark.read.parquet(path), took, seconds))
        else:
            runs.append(Run(name, "timed_out" if said == "timed_out" else "failed", f"stopped after {seconds:g} s" if said == "timed_out" else said, None, took, seconds))
    return runs


def run_records(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """(detector, status, reason, elapsed_seconds, limit_seconds)."""
    return spark.createDataFrame([(r.detector, r.status, r.reason, r.elapsed_seconds, r.limit_seconds) for r in runs], "detector string, status string, reason string, elapsed_seconds double, limit_seconds double")


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))
