"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where that is unset, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or ""
    if not found and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shelfmark-"))
    return found or sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared folder and read again: later uses see the same rows, and lost executors cost one task each."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
