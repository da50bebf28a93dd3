"""Radio sessions: what is heard and liked moves the vector that the next tracks are sought with.

A session is opened by a user's first event and ends four hours after the last one. Its
base is the vector of the first track started in it. Each like pulls by the liked track's
vector, each skip or dislike pushes by half; the newest counts in full, each one before by
DECAY less; a dial scales all of it. Tracks without a vector still let earlier feedback age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import unit
from . import sessions

TTL_S = 4 * 3600
#: Most tracks remembered of a session, the latest.
HEARD = 50
#: What feedback weighs, how it ages, how much of it counts, and where a dial leaves it as it is.
WEIGHTS = {"like": 1.5, "dislike": -0.5, "skip": -0.25}
DECAY, SHARE, BALANCED = 0.9, 0.30, 0.3
KINDS = ("play_start", *WEIGHTS)


def dial_scale(dial: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 + (dial - BALANCED))


def feedback() -> Column:
    """What an event weighs; null where it is no feedback."""
    return F.coalesce(*[F.when(F.col("event_type") == k, F.lit(w)) for k, w in WEIGHTS.items()])


def split(events: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """The events that sessions are made of, with session_no: a pause of more than ttl_s ends a session."""
    return sessions.split(events.filter(F.col("event_type").isin(*KINDS)), ttl_s + 1)


def fold(events: DataFrame, library: DataFrame, dial: Column | None = None, ttl_s: int = TTL_S) -> DataFrame:
    """user_id, session_no, last_active, feedback, heard, v: each session as it stands after its last event.

    v is null where no started track has a vector, and the base where feedback cancels it out.
    """
    own = split(events, ttl_s)
    keys = ["user_id", "session_no"]
    by = Window.partitionBy(*keys)
    newest = by.orderBy(F.desc("ts"), F.desc("id"))
    weighed = own.withColumn("w", feedback())
    after = F.sum(F.when(F.col("w").isNotNull(), 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    weighed = weighed.withColumn("w", F.col("w") * F.pow(F.lit(DECAY), F.coalesce(after, F.lit(0))))
    heard = own.filter("event_type = 'play_start'").withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= HEARD)
    heard = heard.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "track_id"))).alias("x")).select(*keys, F.col("x.track_id").alias("heard"))
    header = own.groupBy(*keys).agg(F.max("ts").alias("last_active"), F.count_if(feedback().isNotNull()).alias("feedback"), F.max_by((F.lit(BALANCED) if dial is None else dial), F.struct("ts", "id")).alias("dial"))
    vectors = library.select("track_id", unit(F.col("v")).alias("v"))
    base = own.filter("event_type = 'play_start'").join(vectors, "track_id").groupBy(*keys).agg(F.min_by("v", F.struct("ts", "id")).alias("base"))
    long = weighed.filter("w IS NOT NULL").select(*keys, "track_id", "w").join(vectors, "track_id").select(*keys, "w", F.posexplode("v").alias("at", "x"))
    moved = long.groupBy(*keys, "at").agg(F.sum(F.col("w") * F.col("x")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("p")).select(*keys, F.col("p.s").alias("moved"))
    made = header.join(heard, keys, "left").join(base, keys, "left").join(moved, keys, "left")
    sum_ = F.zip_with("base", "moved", lambda b, m: b + m * SHARE * dial_scale(F.col("dial")))
    v = F.when(F.col("moved").isNull(), F.col("base")).when(F.exists(sum_, lambda x: F.abs(x) > 1e-9), unit(sum_)).otherwise(F.col("base"))
    return made.select(*keys, "last_active", "feedback", F.coalesce("heard", F.array().cast("array<string>")).alias("heard"), v.alias("v"))
