"""Tables that cut lineage, below the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; where none is set, as in tests, a local master gets a temporary one and a cluster an error."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(SETTING, base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Written once and read again: what follows neither parses nor plans it anew, and lost executors cost a rereading."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
