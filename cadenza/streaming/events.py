"""The event log as a stream: late data, duplicates, sessions and rates; each has a batch query of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT = "id long, user_id string, track_id string, event_type string, value double, ts long"
LATE = "24 hours"


def read(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """Files of events as they come, with time for the watermark; progress is kept in the query's checkpoint."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return raw.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", LATE)


def without_future(stream: DataFrame, now: int, most_s: int = 300) -> DataFrame:
    return stream.filter(F.col("ts") <= now + most_s)


def deduplicated(stream: DataFrame) -> DataFrame:
    """One event of those with the same id; state is dropped behind the watermark."""
    return stream.dropDuplicatesWithinWatermark(["id"])


def sessions(stream: DataFrame) -> DataFrame:
    """Sessions by user: a gap of half an hour or more parts them (on whole seconds, 1799 s merge and 1800 s part)."""
    made = stream.groupBy("user_id", F.session_window("time", "1799 seconds")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("events"))
    return made.select("user_id", "started_at", "ended_at", "events")


def rates(stream: DataFrame, width: str = "15 minutes") -> DataFrame:
    counted = stream.groupBy(F.window("time", width)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("window.start").alias("bucket"), "n")


def write(df: DataFrame, path: str, checkpoint: str):
    """Appends what is final to Parquet files, then stops when no files are left."""
    return df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
