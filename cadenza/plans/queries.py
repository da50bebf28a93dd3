"""The library's queries over the canonical tables, and DuckDB SQL for each.

Keys are the survey's row ids with a name. Doubles are rounded to six places on
both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..operators import linking, scoring, sessions
from . import canonical as c
from .canonical import CTES, NOW, ORDERS_NOW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(n), 6) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def query(name: str, sql: str | None, *sources: Callable[[SparkSession, str], DataFrame]) -> Callable:
    """Registers a function of sources and its SQL; without sources, of (events, tracks, interactions, charts), each a function to call."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if sources:
                return rounded(f(*(g(spark, sf_dir) for g in sources)))
            return rounded(f(*(lambda g=g: g(spark, sf_dir) for g in (c.listen_events, c.track_features, c.interactions, c.chart_entries))))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {CTES}{'' if sql.lstrip().startswith('SELECT') else ','} {sql}"
        return f

    return add


SESSIONS = """
lagged AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 1800 THEN 0 ELSE 1 END AS fresh FROM listen_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
numbered AS (SELECT *, (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM lagged)
"""
SCORED = """
signals AS (SELECT user_id, track_id, count_if(event_type = 'play_start')::BIGINT AS plays, count_if(event_type = 'play_end')::BIGINT AS ends, count_if(event_type = 'play_end' AND value >= 0.8)::BIGINT AS full_plays,
  count_if(event_type = 'skip' AND dwell_ms < 2000)::BIGINT AS early_skips, count_if(event_type = 'skip' AND dwell_ms < 2000 AND surface = 'home')::BIGINT AS early_chosen, count_if(event_type = 'skip' AND dwell_ms < 2000 AND surface IN ('radio', 'search'))::BIGINT AS early_offered,
  count_if(event_type = 'skip' AND dwell_ms BETWEEN 2000 AND 29999)::BIGINT AS middle_skips, count_if(event_type = 'skip')::BIGINT AS skips, count_if(event_type = 'like')::BIGINT AS likes,
  count_if(event_type = 'dislike')::BIGINT AS dislikes, count_if(event_type = 'playlist_add')::BIGINT AS playlist_adds, count_if(event_type = 'queue_add')::BIGINT AS queue_adds, count_if(event_type = 'seek_back')::BIGINT AS seeks, count_if(event_type = 'pause')::BIGINT AS pauses,
  sum(dwell_ms)::BIGINT AS dwell_ms, count(DISTINCT session_id) AS sessions, avg(CASE WHEN event_type = 'play_end' THEN value END) AS avg_completion, max(ts) AS last_played_at, min(ts) AS first_played_at FROM listen_events WHERE event_type != 'reco_impression' GROUP BY user_id, track_id),
scored AS (SELECT *, 1.0::DOUBLE * full_plays + 0.2::DOUBLE * middle_skips - 0.5::DOUBLE * (early_skips - early_chosen - early_offered) - 0.75::DOUBLE * early_chosen - 0.25::DOUBLE * early_offered
  + 2.0::DOUBLE * likes - 2.0::DOUBLE * dislikes + 1.5::DOUBLE * playlist_adds + 0.5::DOUBLE * queue_adds + 1.5::DOUBLE * greatest(plays - 1, 0) - 0.3::DOUBLE * greatest(seeks / greatest(plays, 1) - 2, 0) AS raw FROM signals),
normal AS (SELECT *, CASE WHEN count(*) OVER w <= 1 OR max(raw) OVER w - min(raw) OVER w < 1e-9 THEN 0.5 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS satisfaction
  FROM scored WINDOW w AS (PARTITION BY user_id))
"""


# Scans and projections


@query("S02_scan_without_impressions", "SELECT id, user_id, event_type FROM listen_events WHERE id > 100 AND event_type != 'reco_impression'")
def _(e, t, i, ch):
    return e().filter((F.col("id") > 100) & (F.col("event_type") != "reco_impression")).select("id", "user_id", "event_type")


@query("S23_children_of_newest", "SELECT id, request_id FROM listen_events WHERE request_id IN (SELECT request_id FROM listen_events GROUP BY request_id ORDER BY max(id) DESC, request_id LIMIT 20)")
def _(e, t, i, ch):
    newest = e().groupBy("request_id").agg(F.max("id").alias("m")).orderBy(F.desc("m"), "request_id").limit(20)
    return e().join(newest, "request_id", "left_semi").select("id", "request_id")


@query("P03_mood_filter", "SELECT track_id FROM track_features WHERE len(list_filter(mood_tags, lambda m: m.label = 'happy' AND m.confidence > 0.3)) > 0")
def _(e, t, i, ch):
    return t().filter(F.exists("mood_tags", lambda m: (m["label"] == "happy") & (m["confidence"] > 0.3))).select("track_id")


@query("P05_shown_impressions", "SELECT id, surface FROM listen_events WHERE surface IS NULL OR surface NOT IN ('recommend_api')")
def _(e, t, i, ch):
    return e().filter(F.col("surface").isNull() | ~F.col("surface").isin("recommend_api")).select("id", "surface")


@query("P06_noise_filter", "SELECT id FROM listen_events WHERE NOT (event_type = 'play_end' AND coalesce(value, 1) < 0.05)")
def _(e, t, i, ch):
    return e().filter(~((F.col("event_type") == "play_end") & (F.coalesce("value", F.lit(1.0)) < 0.05))).select("id")


@query("P08_user_id_format", "SELECT DISTINCT user_id, regexp_full_match(user_id, '[A-Za-z0-9_.-]{1,64}') AS valid FROM listen_events")
def _(e, t, i, ch):
    return e().select("user_id", F.col("user_id").rlike("^[A-Za-z0-9_.-]{1,64}$").alias("valid")).distinct()


@query("P09_disliked", "SELECT user_id, track_id FROM interactions WHERE dislike_count > 0 OR early_skip_count > 2")
def _(e, t, i, ch):
    return i().filter("dislike_count > 0 OR early_skip_count > 2").select("user_id", "track_id")


@query("P11_semi_known", "SELECT user_id, track_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_played_at DESC, track_id)::INT AS n FROM interactions WHERE play_count BETWEEN 1 AND 2 AND skip_count = 0 AND like_count = 0 AND dislike_count = 0 AND (satisfaction IS NULL OR satisfaction < 0.6)) WHERE n <= 5")
def _(e, t, i, ch):
    known = i().filter("play_count BETWEEN 1 AND 2 AND skip_count = 0 AND like_count = 0 AND dislike_count = 0 AND (satisfaction IS NULL OR satisfaction < 0.6)")
    return scoring.top_per(known, ["user_id"], [F.desc("last_played_at"), F.col("track_id")], 5).select("user_id", "track_id", F.col("rank").alias("n"))


@query("P12_proven", "SELECT user_id, track_id FROM interactions WHERE like_count > 0 OR play_count >= 3 OR satisfaction >= 0.6")
def _(e, t, i, ch):
    return i().filter("like_count > 0 OR play_count >= 3 OR satisfaction >= 0.6").select("user_id", "track_id")


# Joins


@query("J01_interactions_by_artist", "SELECT artist, sum(play_count)::BIGINT AS plays, sum(like_count)::BIGINT AS likes, round(avg(satisfaction), 6) AS satisfaction, count(*) AS tracks FROM interactions JOIN track_features USING (track_id) GROUP BY artist")
def _(e, t, i, ch):
    return i().join(t().select("track_id", "artist"), "track_id").groupBy("artist").agg(F.sum("play_count").alias("plays"), F.sum("like_count").alias("likes"), F.avg("satisfaction").alias("satisfaction"), F.count(F.lit(1)).alias("tracks"))


@query("J02_interactions_with_features", "SELECT user_id, track_id, title, bpm FROM interactions LEFT JOIN track_features USING (track_id) WHERE play_count > 1")
def _(e, t, i, ch):
    return i().filter("play_count > 1").join(t().select("track_id", "title", "bpm"), "track_id", "left").select("user_id", "track_id", "title", "bpm")


@query("J05_unplayed_tracks", "SELECT track_id FROM track_features WHERE track_id NOT IN (SELECT track_id FROM listen_events WHERE track_id IS NOT NULL)")
def _(e, t, i, ch):
    return linking.never_played(t(), e(), ["track_id"])


@query("J06_impressed_not_played", "SELECT DISTINCT user_id, track_id FROM listen_events a WHERE surface = 'home' AND NOT EXISTS (SELECT 1 FROM listen_events b WHERE b.event_type = 'play_start' AND a.user_id = b.user_id AND a.track_id = b.track_id)")
def _(e, t, i, ch):
    return linking.never_played(e().filter("surface = 'home'"), e().filter("event_type = 'play_start'"), ["user_id", "track_id"])


@query("J07_streams_of_impressions", "SELECT id, request_id FROM listen_events WHERE event_type = 'play_end' AND request_id IN (SELECT request_id FROM listen_events WHERE event_type = 'reco_impression')")
def _(e, t, i, ch):
    return e().filter("event_type = 'play_end'").join(e().filter("event_type = 'reco_impression'"), "request_id", "left_semi").select("id", "request_id")


@query("J08_streamed_flag", "SELECT i.id, EXISTS (SELECT 1 FROM listen_events s WHERE s.event_type IN ('play_start', 'play_end') AND s.request_id = i.request_id AND s.track_id = i.track_id) AS streamed FROM listen_events i WHERE i.event_type = 'reco_impression'")
def _(e, t, i, ch):
    return linking.with_flag(e().filter("event_type = 'reco_impression'"), e().filter("event_type IN ('play_start', 'play_end')"), ["request_id", "track_id"], "streamed").select("id", "streamed")


@query("J10_band_neighbours", "SELECT a.track_id AS seed, count(*) AS n, round(avg(b.bpm), 6) AS bpm FROM track_features a JOIN track_features b ON a.mode = b.mode AND abs(a.bpm - b.bpm) <= 15 AND b.energy BETWEEN greatest(a.energy - 0.25, 0) AND least(a.energy + 0.25, 1) AND a.track_id != b.track_id GROUP BY a.track_id")
def _(e, t, i, ch):
    return linking.band_sums(t())


@query(
    "J11_play_history",
    """
ends AS (SELECT user_id, session_id, track_id, max_by(value, ts * 1000000 + id) AS session_value FROM listen_events WHERE event_type = 'play_end' AND session_id IS NOT NULL GROUP BY ALL),
later AS (SELECT *, (SELECT arg_min(b.value, b.ts * 1000000 + b.id) FROM listen_events b WHERE b.event_type = 'play_end' AND b.user_id = a.user_id AND b.track_id = a.track_id AND (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id))) AS next_value
  FROM listen_events a WHERE event_type = 'play_start')
SELECT id, user_id, track_id, ts, round(coalesce(session_value, next_value), 6) AS completion FROM later LEFT JOIN ends USING (user_id, session_id, track_id)""",
)
def _(e, t, i, ch):
    return sessions.play_history(e())


@query("J13_charts_as_of", "last AS (SELECT scope, max(snapshot_date) AS d FROM chart_entries WHERE snapshot_date <= DATE '1997-06-15' GROUP BY scope) SELECT c.scope, snapshot_date, entry, position FROM chart_entries c JOIN last l ON c.scope = l.scope AND snapshot_date = d")
def _(e, t, i, ch):
    return linking.latest_as_of(ch(), F.lit("1997-06-15").cast("date"), ["scope"]).select("scope", "snapshot_date", "entry", "position")


@query(
    "J15_chart_change",
    "dates AS (SELECT scope, snapshot_date, lag(snapshot_date) OVER (PARTITION BY scope ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT scope, snapshot_date FROM chart_entries)) SELECT c.scope, c.snapshot_date, c.entry, c.position, o.position - c.position AS change FROM chart_entries c JOIN dates d ON c.scope = d.scope AND c.snapshot_date = d.snapshot_date LEFT JOIN chart_entries o ON o.scope = c.scope AND o.snapshot_date = d.before AND o.entry = c.entry",
)
def _(e, t, i, ch):
    return linking.position_change(ch(), ["scope"], "entry").select("scope", "snapshot_date", "entry", "position", "change")


@query("J25_events_of_sessions", f"{SESSIONS} SELECT user_id, session_no, string_agg(track_id, ',' ORDER BY ts, id) AS sequence FROM numbered GROUP BY ALL HAVING count(*) >= 2")
def _(e, t, i, ch):
    own = sessions.split(e()).groupBy("user_id", "session_no").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "track_id"))).alias("x"))
    return own.filter(F.size("x") >= 2).select("user_id", "session_no", F.array_join(F.transform("x", lambda x: x["track_id"]), ",").alias("sequence"))


@query("J26_user_totals", "SELECT user_id, count(*) AS tracks, sum(play_count)::BIGINT AS plays, round(sum(satisfaction), 6) AS satisfaction FROM interactions GROUP BY user_id")
def _(e, t, i, ch):
    return i().groupBy("user_id").agg(F.count(F.lit(1)).alias("tracks"), F.sum("play_count").alias("plays"), F.sum("satisfaction").alias("satisfaction"))


# Aggregations


@query("A02_first_seen_mode", "SELECT user_id, device_type AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM (SELECT user_id, device_type, count(*) AS n, min(ts * 1000000 + id) AS f FROM listen_events GROUP BY ALL)) WHERE r = 1")
def _(e, t, i, ch):
    return sessions.first_seen_mode(e(), ["user_id"], "device_type")


@query("A03_track_signals", f"{SCORED} SELECT * EXCLUDE (full_plays, avg_completion), full_plays AS \"full\", round(avg_completion, 6) AS avg_completion FROM signals")
def _(e, t, i, ch):
    return scoring.signals(e())


@query("D02_scored_interactions", f"{SCORED} SELECT user_id, track_id, round(raw, 6) AS raw, round(satisfaction, 6) AS satisfaction FROM normal")
def _(e, t, i, ch):
    return scoring.normalised(scoring.signals(e()).withColumn("raw", scoring.raw_score())).select("user_id", "track_id", "raw", "satisfaction")


_WEIGHT = f"exp(-({ORDERS_NOW} - last_played_at) / 86400.0 / 365) * (0.1 + satisfaction)"


@query(
    "A06_weighted_feature_stats",
    f"""long AS (SELECT user_id, {_WEIGHT} AS w, unnest([{{'f': 'bpm', 'v': bpm}}, {{'f': 'energy', 'v': energy}}, {{'f': 'valence', 'v': valence}}]) AS x FROM interactions JOIN track_features USING (track_id)),
m AS (SELECT user_id, x.f AS feature, sum(w) AS sw, sum(w * x.v) AS s1, sum(w * x.v * x.v) AS s2 FROM long GROUP BY ALL)
SELECT user_id, feature, round(s1 / sw, 6) AS mean, round(sqrt(greatest(s2 / sw - (s1 / sw) * (s1 / sw), 0)), 3) AS deviation FROM m WHERE sw > 0""",
)
def _(e, t, i, ch):
    weight = scoring.recency("last_played_at", ORDERS_NOW, 365) * (0.1 + F.col("satisfaction"))
    return scoring.weighted_stats(i().join(t(), "track_id"), ["bpm", "energy", "valence"], weight).withColumn("deviation", F.round("deviation", 3))


@query(
    "A08_mood_distribution",
    f"own AS (SELECT user_id, {_WEIGHT} AS w, mood_tags FROM interactions JOIN track_features USING (track_id)), total AS (SELECT user_id, sum(w) AS tw FROM own GROUP BY ALL), long AS (SELECT user_id, w, unnest(mood_tags) AS m FROM own) SELECT user_id, m.label AS label, round(sum(w * m.confidence) / any_value(tw), 6) AS share FROM long JOIN total USING (user_id) GROUP BY ALL",
)
def _(e, t, i, ch):
    own = i().join(t(), "track_id").withColumn("w", scoring.recency("last_played_at", ORDERS_NOW, 365) * (0.1 + F.col("satisfaction")))
    # a row more of each play, for the user's whole weight, so that plays are made once
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("confidence")))
    moods = F.transform(F.coalesce("mood_tags", F.array().cast("array<struct<label:string,confidence:double>>")), lambda m: F.struct(F.lit(False).alias("whole"), m["label"].alias("label"), m["confidence"].alias("confidence")))
    long = own.select("user_id", "w", F.inline(F.concat(whole, moods))).groupBy("user_id", "whole", "label").agg(F.sum(F.col("w") * F.col("confidence")).alias("s"))
    total = F.max(F.when(F.col("whole"), F.col("s"))).over(Window.partitionBy("user_id"))
    return long.withColumn("tw", total).filter("NOT whole").select("user_id", "label", (F.col("s") / F.col("tw")).alias("share"))


@query("A10_share_per_hour", "SELECT user_id, hour_of_day, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM listen_events GROUP BY user_id, hour_of_day")
def _(e, t, i, ch):
    return scoring.shares(e(), "user_id", "hour_of_day")


@query("A13_active_days", "SELECT user_id, count(DISTINCT d) AS days FROM (SELECT user_id, last_played_at // 86400 AS d FROM interactions UNION SELECT user_id, first_played_at // 86400 FROM interactions) GROUP BY user_id")
def _(e, t, i, ch):
    day = F.explode(F.array(F.floor(F.col("first_played_at") / 86400), F.floor(F.col("last_played_at") / 86400)))
    return i().select("user_id", day.alias("d")).groupBy("user_id").agg(F.countDistinct("d").alias("days"))


@query("A16_mean_impression_position", "SELECT user_id, track_id, trunc(avg(position))::INT AS position FROM listen_events WHERE surface = 'home' GROUP BY ALL")
def _(e, t, i, ch):
    return e().filter("surface = 'home'").groupBy("user_id", "track_id").agg(F.avg("position").cast("int").alias("position"))


@query("A17_artist_rollup", "SELECT user_id, artist, sum(play_count)::BIGINT AS plays, sum(like_count)::BIGINT AS likes, round(avg(satisfaction), 6) AS satisfaction, count(*) AS tracks, max(last_played_at) AS last_played_at FROM interactions JOIN track_features USING (track_id) GROUP BY user_id, artist HAVING sum(play_count) > 1")
def _(e, t, i, ch):
    return i().join(t().select("track_id", "artist"), "track_id").groupBy("user_id", "artist").agg(F.sum("play_count").alias("plays"), F.sum("like_count").alias("likes"), F.avg("satisfaction").alias("satisfaction"), F.count(F.lit(1)).alias("tracks"), F.max("last_played_at").alias("last_played_at")).filter("plays > 1")


@query("A18_album_grouping", "SELECT lower(artist) AS artist, lower(album) AS album, count(*) AS tracks, max(track_number) AS last_track, round(avg(bpm), 6) AS bpm, round(avg(energy), 6) AS energy FROM track_features GROUP BY ALL")
def _(e, t, i, ch):
    return t().groupBy(F.lower("artist").alias("artist"), F.lower("album").alias("album")).agg(F.count(F.lit(1)).alias("tracks"), F.max("track_number").alias("last_track"), F.avg("bpm").alias("bpm"), F.avg("energy").alias("energy"))


@query("A19_top_mean", "SELECT artist, round(avg(satisfaction), 6) AS score FROM (SELECT artist, satisfaction, row_number() OVER (PARTITION BY artist ORDER BY satisfaction DESC, user_id, track_id) AS n FROM interactions JOIN track_features USING (track_id)) WHERE n <= 10 GROUP BY artist")
def _(e, t, i, ch):
    best = scoring.top_per(i().join(t().select("track_id", "artist"), "track_id"), ["artist"], [F.desc("satisfaction"), F.col("user_id"), F.col("track_id")], 10)
    return best.groupBy("artist").agg(F.avg("satisfaction").alias("score"))


@query("A22_impression_to_stream", "SELECT user_id, count_if(event_type = 'reco_impression')::BIGINT AS impressions, count(DISTINCT CASE WHEN event_type = 'reco_impression' THEN request_id END) AS requests, count_if(event_type IN ('play_start', 'play_end') AND request_id IN (SELECT request_id FROM listen_events WHERE event_type = 'reco_impression'))::BIGINT AS streams FROM listen_events GROUP BY user_id")
def _(e, t, i, ch):
    flagged = linking.with_flag(e(), e().filter("event_type = 'reco_impression'"), ["request_id"], "shown")
    like = F.col("event_type") == "reco_impression"
    return flagged.groupBy("user_id").agg(F.count_if(like).alias("impressions"), F.countDistinct(F.when(like, F.col("request_id"))).alias("requests"), F.count_if(F.col("event_type").isin("play_start", "play_end") & F.col("shown")).alias("streams"))


@query("A23_events_by_type", f"SELECT event_type, count(*) AS n FROM listen_events WHERE ts >= {NOW} - 86400 GROUP BY event_type")
def _(e, t, i, ch):
    return e().filter(F.col("ts") >= NOW - 86400).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("A24_skip_rate_histogram", f"{SESSIONS}, rate AS (SELECT count_if(event_type = 'skip') / greatest(count_if(event_type = 'play_start'), 1) AS r FROM numbered GROUP BY user_id, session_no) SELECT CASE WHEN r <= 0.1 THEN 1 WHEN r <= 0.3 THEN 2 WHEN r <= 0.6 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM rate GROUP BY bucket")
def _(e, t, i, ch):
    r = F.col("skip_rate")
    bucket = F.when(r <= 0.1, 1).when(r <= 0.3, 2).when(r <= 0.6, 3).otherwise(4)
    return sessions.rollup(e()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("A25_score_histogram", "SELECT least(floor(satisfaction * 10), 9)::INT AS bin, count(*) AS n FROM interactions GROUP BY bin")
def _(e, t, i, ch):
    return i().groupBy(F.least(F.floor(F.col("satisfaction") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("A27_engagement_leaderboard", "SELECT user_id, count(*) AS events, count(DISTINCT track_id) AS tracks, max(ts) AS last_active, round(count_if(event_type = 'skip') / greatest(count_if(event_type = 'play_start'), 1), 6) AS skip_rate, round(count(DISTINCT track_id) / count(*), 6) AS diversity FROM listen_events GROUP BY user_id ORDER BY events DESC, user_id LIMIT 25")
def _(e, t, i, ch):
    starts, skips = F.count_if(F.col("event_type") == "play_start"), F.count_if(F.col("event_type") == "skip")
    board = e().groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("track_id").alias("tracks"), F.max("ts").alias("last_active"), (skips / F.greatest(starts, F.lit(1))).alias("skip_rate"), (F.countDistinct("track_id") / F.count(F.lit(1))).alias("diversity"))
    return board.orderBy(F.desc("events"), "user_id").limit(25)


@query("A30_success_rate", "SELECT device_type, count_if(event_type = 'play_end')::BIGINT AS ok, count_if(event_type = 'pause')::BIGINT AS failed, round(count_if(event_type = 'play_end') / nullif(count_if(event_type IN ('play_end', 'pause')), 0), 6) AS rate FROM listen_events GROUP BY device_type")
def _(e, t, i, ch):
    ok, bad = F.count_if(F.col("event_type") == "play_end"), F.count_if(F.col("event_type") == "pause")
    return e().groupBy("device_type").agg(ok.alias("ok"), bad.alias("failed"), F.try_divide(ok, ok + bad).alias("rate"))


@query("A35_genre_counts", "SELECT trim(g) AS genre, count(*) AS n FROM (SELECT unnest(string_split(genre, ',')) AS g FROM track_features) GROUP BY ALL ORDER BY n DESC, genre LIMIT 5")
def _(e, t, i, ch):
    return t().select(F.explode(F.split("genre", ",")).alias("g")).groupBy(F.trim("g").alias("genre")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "genre").limit(5)


@query("A36_harmonic_artist_score", "SELECT entry, round(sum(1.0 / position), 6) AS score FROM chart_entries GROUP BY entry")
def _(e, t, i, ch):
    return ch().groupBy("entry").agg(F.sum(1.0 / F.col("position")).alias("score"))


@query("A38_library_invariants", "SELECT count_if(bpm < 40 OR bpm > 250)::BIGINT AS bad_bpm, count_if(energy < 0 OR energy > 1)::BIGINT AS bad_energy, count_if(analysis_error IS NOT NULL)::BIGINT AS failed, round(count_if(analysis_version = (SELECT max(analysis_version) FROM track_features)) / nullif(count(*), 0), 6) AS latest FROM track_features")
def _(e, t, i, ch):
    newest = t().agg(F.max("analysis_version").alias("newest"))
    return t().join(F.broadcast(newest)).agg(F.count_if((F.col("bpm") < 40) | (F.col("bpm") > 250)).alias("bad_bpm"), F.count_if((F.col("energy") < 0) | (F.col("energy") > 1)).alias("bad_energy"), F.count_if(F.col("analysis_error").isNotNull()).alias("failed"), F.try_divide(F.count_if(F.col("analysis_version") == F.col("newest")), F.count(F.lit(1))).alias("latest"))


# Windows


@query("W01_gap_sessions", f"{SESSIONS} SELECT id, user_id, session_no FROM numbered")
def _(e, t, i, ch):
    return sessions.split(e()).select("id", "user_id", "session_no")


@query("W02_client_sessions", "lagged AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < CASE WHEN session_id IS NULL THEN 1800 ELSE 86400 END THEN 0 ELSE 1 END AS fresh FROM listen_events WINDOW w AS (PARTITION BY user_id, session_id ORDER BY ts, id)) SELECT id, (sum(fresh) OVER (PARTITION BY user_id, session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM lagged")
def _(e, t, i, ch):
    return sessions.split_by_client(e()).select("id", "session_no")


@query("W03_without_repeats", "SELECT id, track_id FROM (SELECT *, lag(track_id) OVER (PARTITION BY user_id ORDER BY ts, id) AS before FROM listen_events) WHERE before IS NULL OR before != track_id")
def _(e, t, i, ch):
    return sessions.without_repeats(e()).select("id", "track_id")


@query("W04_first_per_session", f"{SESSIONS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id, session_no, track_id ORDER BY ts, id) AS n FROM numbered) WHERE n = 1")
def _(e, t, i, ch):
    return sessions.first_per_session(e()).select("id")


@query("W07_top_tracks_per_artist", "SELECT artist, track_id, plays, rank FROM (SELECT artist, track_id, sum(play_count)::BIGINT AS plays, row_number() OVER (PARTITION BY artist ORDER BY sum(play_count) DESC, track_id)::INT AS rank FROM interactions JOIN track_features USING (track_id) GROUP BY artist, track_id) WHERE rank <= 5")
def _(e, t, i, ch):
    plays = i().join(t().select("track_id", "artist"), "track_id").groupBy("artist", "track_id").agg(F.sum("play_count").alias("plays"))
    return scoring.top_per(plays, ["artist"], [F.desc("plays"), F.col("track_id")], 5).select("artist", "track_id", "plays", "rank")


@query("W11_feedback_weight", "SELECT id, round(power(0.85, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) - 1), 6) AS weight FROM listen_events WHERE event_type IN ('like', 'skip')")
def _(e, t, i, ch):
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))) - 1
    return e().filter("event_type IN ('like', 'skip')").select("id", F.pow(F.lit(0.85), back).alias("weight"))


@query("W19_upper_median", "SELECT user_id, median FROM (SELECT user_id, satisfaction AS median, row_number() OVER (PARTITION BY user_id ORDER BY satisfaction) - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM interactions) WHERE a = n // 2")
def _(e, t, i, ch):
    return scoring.upper_median(i(), "user_id", "satisfaction")


@query("W20_running_duration", "SELECT track_id, (sum(duration_ms) OVER (PARTITION BY artist ORDER BY track_number, track_id ROWS UNBOUNDED PRECEDING))::BIGINT AS elapsed FROM track_features")
def _(e, t, i, ch):
    w = Window.partitionBy("artist").orderBy("track_number", "track_id").rowsBetween(Window.unboundedPreceding, 0)
    return t().select("track_id", F.sum("duration_ms").over(w).alias("elapsed"))


@query("W24_retry_backoff", "SELECT id, least(3600 * power(2, position), 2592000)::BIGINT AS wait_s FROM listen_events WHERE event_type = 'pause'")
def _(e, t, i, ch):
    return e().filter("event_type = 'pause'").select("id", F.least(F.lit(3600) * F.pow(F.lit(2.0), F.col("position")), F.lit(2592000)).cast("long").alias("wait_s"))


# Top-k and sets


@query("T05_best_and_worst", "SELECT * FROM (SELECT 'best' AS side, user_id, track_id, satisfaction FROM interactions ORDER BY satisfaction DESC, user_id, track_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'worst', user_id, track_id, satisfaction FROM interactions ORDER BY satisfaction, user_id, track_id LIMIT 10)")
def _(e, t, i, ch):
    side = lambda name, order: i().orderBy(order, "user_id", "track_id").limit(10).select(F.lit(name).alias("side"), "user_id", "track_id", "satisfaction")
    return side("best", F.desc("satisfaction")).unionByName(side("worst", F.asc("satisfaction")))


@query("U01_exclusions", f"SELECT user_id, track_id FROM interactions WHERE dislike_count > 0 UNION SELECT user_id, track_id FROM interactions WHERE early_skip_count > 0 AND last_played_at >= {ORDERS_NOW} - 86400 * 900")
def _(e, t, i, ch):
    disliked = i().filter("dislike_count > 0").select("user_id", "track_id")
    return disliked.union(i().filter((F.col("early_skip_count") > 0) & (F.col("last_played_at") >= ORDERS_NOW - 86400 * 900)).select("user_id", "track_id")).distinct()


# Functions


@query("F01_normalised_names", r"SELECT DISTINCT artist, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(artist)), '^the ', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM track_features")
def _(e, t, i, ch):
    return t().select("artist", text.normalised(F.col("artist")).alias("norm")).distinct()


@query("F08_artist_of_path", "SELECT track_id, string_split(file_path, '/')[-3] AS artist, upper(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS format, substr(sha256(file_path), 1, 16) AS key FROM track_features")
def _(e, t, i, ch):
    p = F.col("file_path")
    return t().select("track_id", text.artist_of_path(p).alias("artist"), text.format_of_path(p).alias("format"), text.track_key(p).alias("key"))


@query("F18_decays", f"SELECT user_id, track_id, round(exp(-({ORDERS_NOW} - last_played_at) / 86400.0 / 365), 6) AS recency, round(power(0.5, ({ORDERS_NOW} - last_played_at) / 86400.0 / 180), 6) AS half FROM interactions")
def _(e, t, i, ch):
    return i().select("user_id", "track_id", scoring.recency("last_played_at", ORDERS_NOW, 365).alias("recency"), scoring.half_life("last_played_at", ORDERS_NOW, 180).alias("half"))


@query("F27_cyclic_hours", "SELECT id, round(sin(2 * pi() * hour_of_day / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour_of_day / 24), 6) + 0.0 AS hour_cos FROM listen_events")
def _(e, t, i, ch):
    angle = 2 * F.pi() * F.col("hour_of_day") / 24
    return e().select("id", F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"))


@query("F37_dominant_mood", "SELECT track_id, list_max(list_transform(mood_tags, lambda m: {'confidence': m.confidence, 'label': m.label})).label AS mood FROM track_features")
def _(e, t, i, ch):
    return t().select("track_id", F.array_max(F.transform("mood_tags", lambda m: F.struct(m["confidence"].alias("confidence"), m["label"].alias("label"))))["label"].alias("mood"))


# Time windows and states


@query("ST06_activity_pivot", "SELECT ts // 3600 * 3600 AS bucket, count_if(event_type = 'play_start')::BIGINT AS play_start, count_if(event_type = 'play_end')::BIGINT AS play_end, count_if(event_type = 'skip')::BIGINT AS skip FROM listen_events GROUP BY bucket")
def _(e, t, i, ch):
    kinds = ["play_start", "play_end", "skip"]
    return e().groupBy((F.floor(F.col("ts") / 3600) * 3600).alias("bucket")).pivot("event_type", kinds).count().na.fill(0, kinds)


@query("ST08_rate_limit", "SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS recent FROM listen_events")
def _(e, t, i, ch):
    return e().select("id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(-3599, 0)).alias("recent"))


@query("ST12_suppressed", "SELECT user_id, track_id, max(CASE WHEN event_type = 'skip' THEN ts END) > coalesce(max(CASE WHEN event_type = 'play_start' THEN ts END), 0) AS suppressed FROM listen_events GROUP BY user_id, track_id HAVING count_if(event_type = 'skip') > 0")
def _(e, t, i, ch):
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    both = e().groupBy("user_id", "track_id").agg(at("skip").alias("s"), at("play_start").alias("p")).filter("s IS NOT NULL")
    return both.select("user_id", "track_id", (F.col("s") > F.coalesce("p", F.lit(0))).alias("suppressed"))


@query("ST20_scrobble_batches", "SELECT id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - 1) // 50 AS batch FROM listen_events WHERE event_type = 'play_end'")
def _(e, t, i, ch):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id")) - 1
    return e().filter("event_type = 'play_end'").select("id", F.floor(n / 50).alias("batch"))


@query("X06_catalogue_bins", "SELECT CASE WHEN bpm < 60 THEN 0 WHEN bpm >= 200 THEN 11 ELSE floor((bpm - 60) / 14) + 1 END::BIGINT AS bin, count(*) AS n FROM track_features GROUP BY bin")
def _(e, t, i, ch):
    return t().groupBy(F.width_bucket("bpm", F.lit(60.0), F.lit(200.0), F.lit(10)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# Metrics


@query("E01_ndcg", "ranked AS (SELECT user_id, satisfaction AS rel, row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC, track_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY satisfaction DESC, track_id) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC, track_id) AS k FROM interactions) WHERE k <= 10) SELECT user_id, round(sum(rel / log2(r + 1)) / nullif(sum(rel / log2(ideal + 1)), 0), 6) AS ndcg FROM ranked GROUP BY user_id")
def _(e, t, i, ch):
    top = scoring.top_per(i(), ["user_id"], [F.desc("play_count"), F.col("track_id")], 10)
    ideal = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("satisfaction"), "track_id"))
    gain = lambda rank: F.sum(F.col("satisfaction") / F.log2(F.col(rank) + 1))
    return top.withColumn("ideal", ideal).groupBy("user_id").agg(F.try_divide(gain("rank"), gain("ideal")).alias("ndcg"))


@query("E05_novelty", "SELECT user_id, round(avg(1.0 / (1 + plays)), 6) AS novelty FROM interactions JOIN (SELECT track_id, sum(play_count) AS plays FROM interactions GROUP BY ALL) USING (track_id) GROUP BY user_id")
def _(e, t, i, ch):
    popularity = i().groupBy("track_id").agg(F.sum("play_count").alias("plays"))
    return i().join(popularity, "track_id").groupBy("user_id").agg(F.avg(1.0 / (1 + F.col("plays"))).alias("novelty"))


@query("E08_coverage", "SELECT round(count(DISTINCT track_id) / (SELECT count(*) FROM track_features), 6) AS coverage FROM interactions")
def _(e, t, i, ch):
    total = t().agg(F.count(F.lit(1)).alias("n"))
    return i().agg(F.countDistinct("track_id").alias("k")).join(F.broadcast(total)).select((F.col("k") / F.col("n")).alias("coverage"))
