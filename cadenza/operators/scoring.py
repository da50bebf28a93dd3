"""Scores of a user's tracks from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sessions import is_type

# Weights of signals, and the bounds in ms of early and middle skips.
FULL, MIDDLE, EARLY, LIKE, DISLIKE, REPEAT = 1.0, 0.2, -0.5, 2.0, -2.0, 1.5
EARLY_CHOSEN, EARLY_OFFERED, PLAYLIST, QUEUE, SEEK = -0.75, -0.25, 1.5, 0.5, -0.3
EARLY_MS, MIDDLE_MS = 2000, 30000
#: Where an early skip weighs more (chosen by the user) or less (offered to them) than elsewhere.
CHOSEN, OFFERED = ("home",), ("radio", "search")


def signals(events: DataFrame) -> DataFrame:
    """Per user and track the counts that a score is made of; impressions do not count."""
    own = events.filter(~is_type("reco_impression"))
    skip = is_type("skip")
    early = skip & (F.col("dwell_ms") < EARLY_MS)
    surface = F.coalesce("surface", F.lit(""))
    return own.groupBy("user_id", "track_id").agg(
        F.count_if(is_type("play_start")).alias("plays"), F.count_if(is_type("play_end")).alias("ends"), F.count_if(is_type("play_end") & (F.col("value") >= 0.8)).alias("full"),
        F.count_if(early).alias("early_skips"), F.count_if(early & surface.isin(*CHOSEN)).alias("early_chosen"), F.count_if(early & surface.isin(*OFFERED)).alias("early_offered"),
        F.count_if(skip & F.col("dwell_ms").between(EARLY_MS, MIDDLE_MS - 1)).alias("middle_skips"), F.count_if(skip).alias("skips"),
        F.count_if(is_type("like")).alias("likes"), F.count_if(is_type("dislike")).alias("dislikes"), F.count_if(is_type("playlist_add")).alias("playlist_adds"),
        F.count_if(is_type("queue_add")).alias("queue_adds"), F.count_if(is_type("seek_back")).alias("seeks"), F.count_if(is_type("pause")).alias("pauses"),
        F.sum("dwell_ms").alias("dwell_ms"), F.countDistinct("session_id").alias("sessions"),
        F.avg(F.when(is_type("play_end"), F.col("value"))).alias("avg_completion"), F.max("ts").alias("last_played_at"), F.min("ts").alias("first_played_at"),
    )


def raw_score() -> Column:
    """What the signals of a user's track are worth; seeks count beyond two for each play."""
    plain = F.col("early_skips") - F.col("early_chosen") - F.col("early_offered")
    early = EARLY * plain + EARLY_CHOSEN * F.col("early_chosen") + EARLY_OFFERED * F.col("early_offered")
    seeks = F.greatest(F.col("seeks") / F.greatest(F.col("plays"), F.lit(1)) - 2, F.lit(0.0))
    wanted = LIKE * F.col("likes") + DISLIKE * F.col("dislikes") + PLAYLIST * F.col("playlist_adds") + QUEUE * F.col("queue_adds")
    return FULL * F.col("full") + MIDDLE * F.col("middle_skips") + early + wanted + REPEAT * F.greatest(F.col("plays") - 1, F.lit(0)) + SEEK * seeks


def normalised(scored: DataFrame, score: str = "raw", key: str = "user_id") -> DataFrame:
    """satisfaction: score from 0 to 1 within its user; 0.5 where the user has one track or all alike."""
    w = Window.partitionBy(key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn("satisfaction", F.when((F.count(F.lit(1)).over(w) <= 1) | (high - low < 1e-9), 0.5).otherwise((F.col(score) - low) / (high - low)))


def recency(ts: str, now: int, days: float) -> Column:
    return F.exp(-(F.lit(now) - F.col(ts)) / 86400.0 / days)


def half_life(ts: str, now: int, days: float) -> Column:
    return F.pow(F.lit(0.5), (F.lit(now) - F.col(ts)) / 86400.0 / days)


def weighted_stats(joined: DataFrame, features: list[str], weight: Column) -> DataFrame:
    """user_id, feature, mean and population deviation, weighted; all sums of a user are one row, so that a play is not copied for each feature."""
    weighed = joined.select("user_id", weight.alias("w"), *(F.col(f).cast("double").alias(f) for f in features))
    power = lambda f, n: F.sum(F.when(F.col(f).isNotNull(), F.col("w") * (F.col(f) if n else F.lit(1.0)) * (F.col(f) if n > 1 else F.lit(1.0)))).alias(f"{f}_{n}")
    sums = weighed.groupBy("user_id").agg(*(power(f, n) for f in features for n in range(3)))
    long = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_0").alias("sw"), F.col(f"{f}_1").alias("s1"), F.col(f"{f}_2").alias("s2")) for f in features])
    m = sums.select("user_id", F.explode(long).alias("x")).select("user_id", "x.*")
    mean = F.col("s1") / F.col("sw")
    return m.filter("sw > 0").select("user_id", "feature", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("sw") - mean * mean, F.lit(0.0))).alias("deviation"))


def shares(events: DataFrame, key: str, value: str) -> DataFrame:
    """The share of each value in its group."""
    counted = events.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """The item at place n // 2 of each sorted group."""
    w = Window.partitionBy(key)
    ranked = df.filter(F.col(value).isNotNull()).withColumn("at", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("at") == F.floor(F.col("n") / 2)).select(key, F.col(value).alias("median"))
