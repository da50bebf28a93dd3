"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and Spark is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cadenza-tables-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read again, so that it is made once and a lost executor loses none of it."""
    at = path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
