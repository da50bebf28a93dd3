"""Sessions of the event log, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GAP_S, CAP_S = 1800, 86400


def split(events: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """events with session_no: a new session begins where a user pauses for gap_s or longer."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "id")
    new = F.when(F.col("ts") - F.lag("ts").over(by_user) < gap_s, 0).otherwise(1)
    return events.withColumn("session_no", F.sum(new).over(by_user.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def split_by_client(events: DataFrame, gap_s: int = GAP_S, cap_s: int = CAP_S) -> DataFrame:
    """The same, by the client's session id first: inside an id only cap_s parts sessions, without one gap_s does."""
    within = Window.partitionBy("user_id", "session_id").orderBy("ts", "id")
    limit = F.when(F.col("session_id").isNull(), gap_s).otherwise(cap_s)
    new = F.when(F.col("ts") - F.lag("ts").over(within) < limit, 0).otherwise(1)
    return events.withColumn("session_no", F.sum(new).over(within.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def is_type(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def rollup(events: DataFrame, gap_s: int = GAP_S, least_events: int = 1) -> DataFrame:
    """A row for each session: span, counts, ratios, mean completion and dwell."""
    starts = F.count_if(is_type("play_start"))
    skips = F.count_if(is_type("skip"))
    agg = split(events, gap_s).groupBy("user_id", "session_no").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), (F.max("ts") - F.min("ts")).alias("duration_s"), F.count(F.lit(1)).alias("events"),
        F.countDistinct("track_id").alias("tracks"), starts.alias("plays"), skips.alias("skips"), F.count_if(is_type("like")).alias("likes"),
        (skips / F.greatest(starts, F.lit(1))).alias("skip_rate"), F.avg(F.when(is_type("play_end"), F.col("value"))).alias("avg_completion"), F.sum("dwell_ms").alias("dwell_ms"),
        F.min_by("hour_of_day", F.struct("ts", "id")).alias("hour_of_day"), F.min_by("surface", F.struct("ts", "id")).alias("surface"),
        F.count_if(is_type("pause")).alias("pauses"), F.count_if(is_type("reco_impression")).alias("impressions"),
    )
    return agg.filter(F.col("events") >= least_events)


def first_seen_mode(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each group; of equally common ones that seen first."""
    counted = events.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(*keys, F.col(value).alias("mode"), "n")


def without_repeats(events: DataFrame) -> DataFrame:
    """events without those whose track is the one just before."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "id")
    return events.withColumn("before", F.lag("track_id").over(by_user)).filter(F.col("before").isNull() | (F.col("before") != F.col("track_id"))).drop("before")


def first_per_session(events: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """The first event of each track in each session."""
    w = Window.partitionBy("user_id", "session_no", "track_id").orderBy("ts", "id")
    return split(events, gap_s).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def play_history(events: DataFrame) -> DataFrame:
    """Each play_start with its completion: the latest play_end of its client session and track, else the next play_end of the track."""
    ends = events.filter(is_type("play_end"))
    by_session = ends.filter(F.col("session_id").isNotNull()).groupBy("user_id", "session_id", "track_id").agg(F.max_by("value", F.struct("ts", "id")).alias("session_value"))
    later = Window.partitionBy("user_id", "track_id").orderBy("ts", "id").rowsBetween(1, Window.unboundedFollowing)
    following = events.withColumn("next_value", F.first(F.when(is_type("play_end"), F.col("value")), ignorenulls=True).over(later)).filter(is_type("play_start"))
    return following.join(by_session, ["user_id", "session_id", "track_id"], "left").select("id", "user_id", "track_id", "ts", F.coalesce("session_value", "next_value").alias("completion"))
