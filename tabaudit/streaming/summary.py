"""Event streams summarised into series as they arrive, for the detectors to look at."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import shared_folder


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day and event_type; events that come more than `late` after the newest of earlier batches may be left out, so that
    state doesn't grow without end. ts may lack a time zone."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))


def summarise(spark: SparkSession, folder: str, files: str, out: str, late: str = "1 day") -> None:
    """Takes all files of a folder that the pattern names and weren't taken before, and writes each batch's changed counts below `out`,
    a folder a batch: a batch that is run again replaces its own."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema

    def write(batch: DataFrame, number: int) -> None:
        batch.select("w.start", "event_type", "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    stream = daily_counts(spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder), late)
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def summary(spark: SparkSession, out: str) -> DataFrame:
    """The latest count of each day and type."""
    rows = spark.read.schema("start timestamp, event_type string, n long, batch int").parquet(f"{out}/counts")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def run_once(spark: SparkSession, folder: str, files: str) -> DataFrame:
    out = f"{shared_folder(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"
    summarise(spark, folder, files, out)
    return summary(spark, out)
