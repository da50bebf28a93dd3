"""Derived tables on files: days replaced, rows appended once, old days dropped.

Tables are Parquet folders with a folder for each day, so that a write touches only the
days it brings and retention removes folders instead of rewriting rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def parts(spark: SparkSession, path: str, by: str) -> list[str]:
    """The values of the partition column by that have a folder."""
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n[len(by) + 1 :] for n in names if n.startswith(f"{by}="))


def replace_parts(df: DataFrame, path: str, by: str) -> None:
    """Writes df by partitions of `by`: those it holds are replaced whole, others are not touched. Writing twice changes nothing."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], by: str) -> None:
    """Appends the rows of df whose keys the table lacks, each key once (its first row in order of all columns).

    Only partitions that df may fall in are read for that; keys are compared within a partition.
    """
    spark = df.sparkSession
    one = df.groupBy(by, *keys).agg(F.min(F.struct(*[c for c in df.columns if c not in (by, *keys)])).alias("_r")).select(by, *keys, "_r.*").select(*df.columns)
    if exists(spark, path):
        own = spark.read.parquet(path).select(F.col(by).cast(df.schema[by].dataType).alias(by), *keys)
        one = one.join(own, [by, *keys], "left_anti")
    one.write.mode("append").partitionBy(by).parquet(path)


def retain(spark: SparkSession, path: str, by: str, least: str) -> list[str]:
    """Drops the partitions of `by` before least (as text of equal form, such as dates); returns their values."""
    fs, _ = _fs(spark, path)
    old = [v for v in parts(spark, path, by) if v < least]
    for v in old:
        fs.delete(_fs(spark, f"{path}/{by}={v}")[1], True)
    return old


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table, with the columns of like in their order."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)
