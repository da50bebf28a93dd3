"""Taste profiles, session figures, charts over time and the dashboards drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..operators import linking, scoring, sessions, vectors
from . import canonical as c
from .canonical import NOW, ORDERS_NOW
from .queries import SCORED, SESSIONS, query

events, tracks, plays = c.listen_events, c.track_features, c.interactions
SCALES = {"short": 7.0, "main": 30.0, "long": 365.0}


def weight(days: float) -> F.Column:
    """Of an interaction: recent and satisfying ones count more."""
    return scoring.recency("last_played_at", ORDERS_NOW, days) * (0.1 + F.col("satisfaction"))


def sql_weight(days: float) -> str:
    return f"exp(-({ORDERS_NOW} - last_played_at) / 86400.0 / {days}::DOUBLE) * (0.1 + satisfaction)"


@query("A04_merged_states", f"{SCORED} SELECT user_id, track_id, plays, skips, likes, last_played_at FROM signals", events)
def _(e):
    """Signals of two halves of the log, added up."""
    halves = [scoring.signals(e.filter(f"id % 2 = {k}")) for k in (0, 1)]
    both = halves[0].unionByName(halves[1])
    return both.groupBy("user_id", "track_id").agg(*[F.sum(x).alias(x) for x in ("plays", "skips", "likes")], F.max("last_played_at").alias("last_played_at"))


@query("A05_score_range_per_user", f"{SCORED} SELECT user_id, round(min(raw), 6) AS low, round(max(raw), 6) AS high, count(*) AS n FROM scored GROUP BY user_id", events)
def _(e):
    raw = scoring.signals(e).withColumn("raw", scoring.raw_score())
    return raw.groupBy("user_id").agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count(F.lit(1)).alias("n"))


@query("W05_normalised_per_user", f"{SCORED} SELECT user_id, track_id, round(satisfaction, 6) AS satisfaction FROM normal", events)
def _(e):
    return scoring.normalised(scoring.signals(e).withColumn("raw", scoring.raw_score())).select("user_id", "track_id", "satisfaction")


@query("F21_raw_satisfaction", f"{SCORED} SELECT user_id, track_id, round(raw, 6) AS raw FROM scored", events)
def _(e):
    return scoring.signals(e).select("user_id", "track_id", scoring.raw_score().alias("raw"))


@query("X16_backfilled_scores", "SELECT user_id, track_id, round(CASE WHEN play_count % 2 = 0 THEN satisfaction ELSE 1.0 * play_count + 2.0 * like_count - 2.0 * dislike_count END, 6)::DOUBLE AS raw FROM interactions", plays)
def _(i):
    """Missing raw scores from the counts alone, without penalties."""
    kept = F.when(F.col("play_count") % 2 == 0, F.col("satisfaction"))
    return i.select("user_id", "track_id", F.coalesce(kept, scoring.FULL * F.col("play_count") + scoring.LIKE * F.col("like_count") + scoring.DISLIKE * F.col("dislike_count")).alias("raw"))


_LONG = "long AS (SELECT user_id, scale, w, unnest([{'f': 'bpm', 'v': bpm}, {'f': 'energy', 'v': energy}, {'f': 'valence', 'v': valence}]) AS x FROM (" + " UNION ALL ".join(f"SELECT user_id, '{n}' AS scale, {sql_weight(d)} AS w, bpm, energy, valence FROM interactions JOIN track_features USING (track_id)" for n, d in SCALES.items()) + "))"


def at_scales(joined: DataFrame, features: tuple[str, ...] = ("bpm", "energy", "valence")) -> DataFrame:
    """user_id, scale, feature, mean; all sums of a user are one row, so that a play is not copied for each of them."""
    weighed = joined.select("user_id", *features, *(weight(d).alias(f"w_{n}") for n, d in SCALES.items()))
    sums = weighed.groupBy("user_id").agg(*(F.sum(f"w_{n}").alias(f"w_{n}") for n in SCALES), *(F.sum(F.col(f"w_{n}") * F.col(f)).alias(f"{n}_{f}") for n in SCALES for f in features))
    long = F.array(*[F.struct(F.lit(n).alias("scale"), F.lit(f).alias("feature"), F.col(f"w_{n}").alias("sw"), F.col(f"{n}_{f}").alias("s1")) for n in SCALES for f in features])
    return sums.select("user_id", F.explode(long).alias("x")).select("user_id", "x.*").filter("sw > 1e-9").select("user_id", "scale", "feature", F.round(F.col("s1") / F.col("sw"), 3).alias("mean"))


@query("A07_profile_at_three_scales", f"{_LONG} SELECT user_id, scale, x.f AS feature, round(sum(w * x.v) / sum(w), 3) AS mean FROM long GROUP BY ALL HAVING sum(w) > 1e-9", plays, tracks)
def _(i, t):
    return at_scales(i.join(t, "track_id"))


@query("A09_key_distribution", f"own AS (SELECT user_id, key || ' ' || mode AS key, {sql_weight(365)} AS w FROM interactions JOIN track_features USING (track_id)) SELECT user_id, key, round(sum(w) / sum(sum(w)) OVER (PARTITION BY user_id), 6) AS share FROM own GROUP BY user_id, key", plays, tracks)
def _(i, t):
    own = i.join(t, "track_id").groupBy("user_id", F.concat_ws(" ", "key", "mode").alias("key")).agg(F.sum(weight(365)).alias("w"))
    return own.select("user_id", "key", (F.col("w") / F.sum("w").over(Window.partitionBy("user_id"))).alias("share"))


_KINDS = {"hour": "hour_of_day::VARCHAR", "device": "device_type", "surface": "surface", "session": "session_id", "type": "event_type"}


@query("A10_shares_by_category", "long AS (" + " UNION ALL ".join(f"SELECT user_id, '{k}' AS category, {v} AS value FROM listen_events" for k, v in _KINDS.items()) + ") SELECT user_id, category, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id, category), 6) AS share FROM long WHERE value IS NOT NULL GROUP BY user_id, category, value", events)
def _(e):
    """All five categories in one pass over the events."""
    columns = {"hour": F.col("hour_of_day").cast("string"), "device": F.col("device_type"), "surface": F.col("surface"), "session": F.col("session_id"), "type": F.col("event_type")}
    long = e.select("user_id", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("value")) for k, v in columns.items()])).alias("x")).select("user_id", "x.*")
    counted = long.filter("value IS NOT NULL").groupBy("user_id", "category", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id", "category")))


_POPULAR = "pop AS (SELECT track_id, sum(play_count) AS p FROM interactions GROUP BY track_id), med AS (SELECT p AS m FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS nth, count(*) OVER () AS n FROM pop) WHERE nth = n // 2)"


def popularity(i: DataFrame) -> tuple[DataFrame, DataFrame]:
    """track_id, p (plays of all users), and their upper median m."""
    pop = i.groupBy("track_id").agg(F.sum("play_count").alias("p"))
    counts = pop.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # few different counts
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("p"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return pop, running.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("p").alias("m"))


@query("A11_popularity_preference", f"{_POPULAR} SELECT user_id, round(0.5 + 0.5 * tanh(sum({sql_weight(365)} * p) / sum({sql_weight(365)}) / any_value(m) - 1), 6) AS preference FROM interactions JOIN pop USING (track_id), med GROUP BY user_id", plays)
def _(i):
    pop, median = popularity(i)
    own = i.join(pop, "track_id").join(F.broadcast(median)).withColumn("w", weight(365))
    return own.groupBy("user_id").agg((0.5 + 0.5 * F.tanh(F.sum(F.col("w") * F.col("p")) / F.sum("w") / F.first("m") - 1)).alias("preference"))


@query("F26_popularity_squash", f"{_POPULAR} SELECT track_id, round(0.5 + 0.5 * tanh(p / m - 1), 6) AS squashed FROM pop, med", plays)
def _(i):
    pop, median = popularity(i)
    return pop.join(F.broadcast(median)).select("track_id", (0.5 + 0.5 * F.tanh(F.col("p") / F.col("m") - 1)).alias("squashed"))


_ROLLED = f"{SESSIONS}, s AS (SELECT user_id, session_no, count(*) AS events, max(ts) - min(ts) AS seconds, count_if(event_type = 'play_start') AS plays, count_if(event_type = 'skip') AS skips FROM numbered GROUP BY ALL)"


@query("A12_session_averages", f"{_ROLLED} SELECT user_id, count(*) AS sessions, round(avg(events), 6) AS events, round(avg(seconds), 6) AS seconds, round(avg(skips / greatest(plays, 1)), 6) AS skip_rate FROM s GROUP BY user_id", events)
def _(e):
    s = sessions.rollup(e)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.avg("events").alias("events"), F.avg("duration_s").alias("seconds"), F.avg("skip_rate").alias("skip_rate"))


@query("A13_behaviour_summary", "days AS (SELECT user_id, count(DISTINCT d) AS days FROM (SELECT user_id, last_played_at // 86400 AS d FROM interactions UNION SELECT user_id, first_played_at // 86400 FROM interactions) GROUP BY user_id) SELECT user_id, sum(play_count)::BIGINT AS plays, round(sum(skip_count) / greatest(sum(play_count), 1), 6) AS skip_rate, round(sum(satisfaction), 6) AS satisfaction, any_value(days) AS days FROM interactions JOIN days USING (user_id) GROUP BY user_id", plays)
def _(i):
    day = F.explode(F.array(F.floor(F.col("first_played_at") / 86400), F.floor(F.col("last_played_at") / 86400)))
    days = i.select("user_id", day.alias("d")).groupBy("user_id").agg(F.countDistinct("d").alias("days"))
    sums = i.groupBy("user_id").agg(F.sum("play_count").alias("plays"), (F.sum("skip_count") / F.greatest(F.sum("play_count"), F.lit(1))).alias("skip_rate"), F.sum("satisfaction").alias("satisfaction"))
    return sums.join(days, "user_id")


@query("U07_active_days", "SELECT user_id, count(DISTINCT d) AS days FROM (SELECT user_id, unnest([first_played_at // 86400, last_played_at // 86400]) AS d FROM interactions) GROUP BY user_id", plays)
def _(i):
    day = F.explode(F.array(F.floor(F.col("first_played_at") / 86400), F.floor(F.col("last_played_at") / 86400)))
    return i.select("user_id", day.alias("d")).groupBy("user_id").agg(F.countDistinct("d").alias("days"))


@query("A14_popular_tracks", f"SELECT track_id, sum(play_count)::BIGINT AS plays FROM interactions WHERE last_played_at >= {ORDERS_NOW} - 86400 * 1500 GROUP BY track_id ORDER BY plays DESC, track_id LIMIT 50", plays)
def _(i):
    return i.filter(F.col("last_played_at") >= ORDERS_NOW - 86400 * 1500).groupBy("track_id").agg(F.sum("play_count").alias("plays")).orderBy(F.desc("plays"), "track_id").limit(50)


@query("A15_candidate_popularity", "SELECT track_id, sum(play_count)::BIGINT AS plays FROM interactions WHERE track_id IN (SELECT track_id FROM similar_edges WHERE source = 'p7') GROUP BY track_id", plays, c.similar_edges)
def _(i, x):
    return i.join(x.filter("source = 'p7'"), "track_id", "left_semi").groupBy("track_id").agg(F.sum("play_count").alias("plays"))


@query("A26_signal_totals", f"{SCORED} SELECT sum(plays)::BIGINT AS plays, sum(skips)::BIGINT AS skips, sum(likes)::BIGINT AS likes, sum(dislikes)::BIGINT AS dislikes, sum(playlist_adds)::BIGINT AS playlist_adds, sum(queue_adds)::BIGINT AS queue_adds FROM signals", events)
def _(e):
    return scoring.signals(e).agg(*[F.sum(x).alias(x) for x in ("plays", "skips", "likes", "dislikes", "playlist_adds", "queue_adds")])


@query("A28_one_user", "SELECT user_id, count(*) AS events, count(DISTINCT track_id) AS tracks, max(ts) AS last_active, round(count_if(event_type = 'skip') / greatest(count_if(event_type = 'play_start'), 1), 6) AS skip_rate FROM listen_events WHERE user_id = 'u3' GROUP BY user_id", events)
def _(e):
    rate = F.count_if(F.col("event_type") == "skip") / F.greatest(F.count_if(F.col("event_type") == "play_start"), F.lit(1))
    return e.filter("user_id = 'u3'").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("track_id").alias("tracks"), F.max("ts").alias("last_active"), rate.alias("skip_rate"))


@query("A45_most_active", "SELECT user_id, sum(play_count)::BIGINT AS plays FROM interactions GROUP BY user_id ORDER BY plays DESC, user_id LIMIT 25", plays)
def _(i):
    return i.groupBy("user_id").agg(F.sum("play_count").alias("plays")).orderBy(F.desc("plays"), "user_id").limit(25)


@query("A46_distinct_counts", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT request_id) AS requests, count(DISTINCT track_id) AS tracks FROM listen_events", events)
def _(e):
    return e.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("request_id").alias("requests"), F.countDistinct("track_id").alias("tracks"))


@query("D01_sessions", f"{SESSIONS} SELECT user_id, session_no, min(ts) AS started_at, count(*) AS events FROM numbered GROUP BY ALL HAVING count(*) >= 2", events)
def _(e):
    return sessions.rollup(e, least_events=2).select("user_id", "session_no", "started_at", "events")


_PROFILE = f"""base AS (SELECT user_id, {sql_weight(30)} AS w30, {sql_weight(365)} AS w, play_count, skip_count, satisfaction, track_id, energy, valence, bpm, mood_tags FROM interactions JOIN track_features USING (track_id)),
nums AS (SELECT user_id, sum(w * bpm) / sum(w) AS bpm, sum(w * energy) / sum(w) AS energy, sum(w * valence) / sum(w) AS valence, sum(play_count)::BIGINT AS plays, count(*) AS tracks FROM base GROUP BY user_id),
happy AS (SELECT user_id, sum(w * m.confidence) / (SELECT sum(w) FROM base b WHERE b.user_id = l.user_id) AS happy FROM (SELECT user_id, w, unnest(mood_tags) AS m FROM base) l WHERE m.label = 'happy' GROUP BY user_id),
best AS (SELECT user_id, list(track_id ORDER BY satisfaction DESC, track_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY satisfaction DESC, track_id) AS n FROM base) WHERE n <= 50 GROUP BY user_id),
profile AS (SELECT * FROM nums JOIN happy USING (user_id) JOIN best USING (user_id))"""


def profiles(i: DataFrame, t: DataFrame) -> DataFrame:
    """A row for each user: weighted means of features, share of a mood, plays and the fifty best tracks."""
    base = i.join(t, "track_id").withColumn("w", weight(365))
    mean = lambda f: (F.sum(F.col("w") * F.col(f)) / F.sum("w")).alias(f)
    happy = F.coalesce(F.filter("mood_tags", lambda m: m["label"] == "happy")[0]["confidence"], F.lit(0.0))
    nums = base.withColumn("happy", happy).groupBy("user_id").agg(mean("bpm"), mean("energy"), mean("valence"), mean("happy"), F.sum("play_count").alias("plays"), F.count(F.lit(1)).alias("tracks"))
    best = scoring.top_per(i, ["user_id"], [F.desc("satisfaction"), F.col("track_id")], 50).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "track_id"))).alias("x"))
    return nums.join(best.select("user_id", F.col("x.track_id").alias("top")), "user_id")


@query("D03_taste_profiles", f"{_PROFILE} SELECT user_id, round(bpm, 6) AS bpm, round(energy, 6) AS energy, round(valence, 6) AS valence, round(happy, 6) AS happy, plays, tracks, top FROM profile", plays, tracks)
def _(i, t):
    return profiles(i, t)


def _known_less(decay: int) -> F.Column:
    """How much what others know counts: less for each track that a user has."""
    return F.exp(-F.col("tracks") / float(decay))


_EXTERNAL, _ONBOARDING = (f"exp(-tracks / {decay}.0::DOUBLE)" for decay in (150, 80))


@query("D04_enriched_external", f"{_PROFILE}, ext AS (SELECT avg(energy) AS x FROM track_features WHERE track_id IN (SELECT track_id FROM similar_edges)) SELECT user_id, round(CASE WHEN {_EXTERNAL} < 0.05 THEN energy ELSE energy * (1 - {_EXTERNAL}) + {_EXTERNAL} * x END, 5) AS energy FROM profile, ext", plays, tracks, c.similar_edges)
def _(i, t, x):
    """The fewer tracks a user has, the more what related services know of them counts."""
    w = _known_less(150)
    outside = t.join(x, "track_id", "left_semi").agg(F.avg("energy").alias("x"))
    return profiles(i, t).join(F.broadcast(outside)).select("user_id", F.round(F.when(w < 0.05, F.col("energy")).otherwise(F.col("energy") * (1 - w) + w * F.col("x")), 5).alias("energy"))


@query("D05_enriched_onboarding", f"{_PROFILE} SELECT user_id, round(energy * (1 - {_ONBOARDING}) + {_ONBOARDING} * (length(user_id) % 5) / 5.0, 5) AS energy FROM profile", plays, tracks)
def _(i, t):
    w = _known_less(80)
    return profiles(i, t).select("user_id", F.round(F.col("energy") * (1 - w) + w * (F.length("user_id") % 5) / 5.0, 5).alias("energy"))


@query("D06_cold_start", "asked AS (SELECT 'n' || c_custkey AS user_id, 'Brand#' || (c_custkey % 25 + 1) AS artist FROM customer WHERE 'n' || c_custkey NOT IN (SELECT user_id FROM interactions)) SELECT user_id, round(avg(energy), 6) AS energy, round(avg(bpm), 6) AS bpm, 0.15::DOUBLE AS deviation, count(*) AS tracks FROM asked JOIN track_features USING (artist) GROUP BY user_id", lambda s, d: c.read(s, d, "customer"), plays, tracks)
def _(u, i, t):
    """Users without history start from the artists they name."""
    asked = u.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("user_id"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("artist")).join(i, "user_id", "left_anti")
    own = t.groupBy("artist").agg(F.sum("energy").alias("e"), F.sum("bpm").alias("b"), F.count(F.lit(1)).alias("tracks"))
    return asked.join(own, "artist").select("user_id", (F.col("e") / F.col("tracks")).alias("energy"), (F.col("b") / F.col("tracks")).alias("bpm"), F.lit(0.15).alias("deviation"), "tracks")


@query("F48_search_ranges", f"{_PROFILE} SELECT user_id, round(bpm - 15, 5) AS bpm_low, round(bpm + 15, 5) AS bpm_high, round(greatest(energy - 0.2, 0), 5) AS energy_low, round(least(energy + 0.2, 1), 5) AS energy_high FROM profile", plays, tracks)
def _(i, t):
    p = profiles(i, t)
    five = lambda x: F.round(x, 5)
    return p.select("user_id", five(F.col("bpm") - 15).alias("bpm_low"), five(F.col("bpm") + 15).alias("bpm_high"), five(F.greatest(F.col("energy") - 0.2, F.lit(0.0))).alias("energy_low"), five(F.least(F.col("energy") + 0.2, F.lit(1.0))).alias("energy_high"))


@query("F36_mood_match", "SELECT i.user_id, i.track_id, round(list_sum(list_transform(mood_tags, lambda m: m.confidence * CASE m.label WHEN 'happy' THEN 0.6 WHEN 'calm' THEN 0.3 ELSE 0 END)), 6)::DOUBLE AS match FROM interactions i JOIN track_features t ON t.track_id = i.track_id".replace("AS match", "AS fit"), plays, tracks)
def _(i, t):
    wanted = F.create_map(F.lit("happy"), F.lit(0.6), F.lit("calm"), F.lit(0.3))
    fit = F.aggregate("mood_tags", F.lit(0.0), lambda s, m: s + F.coalesce(F.try_element_at(wanted, m["label"]), F.lit(0.0)) * m["confidence"])
    return i.join(t.select("track_id", "mood_tags"), "track_id").select("user_id", "track_id", fit.alias("fit"))


@query("F35_map_default", "counts AS (SELECT user_id, device_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS s FROM listen_events GROUP BY user_id, device_type) SELECT e.user_id, round(coalesce(max(s) FILTER (WHERE device_type = 'car'), 0), 6) AS car, 0.0::DOUBLE AS boat FROM counts e GROUP BY user_id", events)
def _(e):
    shares = scoring.shares(e, "user_id", "device_type").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("device_type", "share"))).alias("m"))
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0))
    return shares.select("user_id", of("car").alias("car"), of("boat").alias("boat"))


@query("F19_half_lives", f"SELECT user_id, track_id, round(power(0.5, ({ORDERS_NOW} - last_played_at) / 86400.0 / 700), 6) AS decay FROM interactions", plays)
def _(i):
    return i.select("user_id", "track_id", scoring.half_life("last_played_at", ORDERS_NOW, 700).alias("decay"))


@query("F22_clamped", "SELECT user_id, track_id, greatest(least(round(satisfaction * 3 - 0.5, 6), 1), 0)::DOUBLE AS x FROM interactions", plays)
def _(i):
    return i.select("user_id", "track_id", text.clamp(F.round(F.col("satisfaction") * 3 - 0.5, 6)).alias("x"))


@query("F23_freshness", f"SELECT user_id, track_id, round(1 - exp(-ln(2) * ({ORDERS_NOW} - last_played_at) / 86400.0 / 60), 6) AS freshness FROM interactions", plays)
def _(i):
    days = (ORDERS_NOW - F.col("last_played_at")) / 86400.0
    return i.select("user_id", "track_id", (1 - F.exp(-F.log(F.lit(2.0)) * days / 60)).alias("freshness"))


_HISTORY = f"round(0.5 * avg(satisfaction) + 0.3 * least(sum(play_count) / 50.0, 1) + 0.2 * exp(-({ORDERS_NOW} - max(last_played_at)) / 86400.0 / 600), 6)"


@query("F24_artist_history_score", f"SELECT user_id, artist, {_HISTORY}::DOUBLE AS score FROM interactions JOIN track_features USING (track_id) GROUP BY ALL", plays, tracks)
def _(i, t):
    recent = F.exp(-(ORDERS_NOW - F.max("last_played_at")) / 86400.0 / 600)
    score = 0.5 * F.avg("satisfaction") + 0.3 * F.least(F.sum("play_count") / 50.0, F.lit(1.0)) + 0.2 * recent
    return i.join(t.select("track_id", "artist"), "track_id").groupBy("user_id", "artist").agg(score.alias("score"))


_HEAT = "least(greatest((1.0 * least(like_count, 2) + 0.8 * least(play_count, 3) - 0.6 * least(skip_count, 4)) / 2, 0), 1)"


def heat(now: int = ORDERS_NOW) -> F.Column:
    """Capped weighted sum of signals, decayed by half in 700 days."""
    capped = 1.0 * F.least("like_count", F.lit(2)) + 0.8 * F.least("play_count", F.lit(3)) - 0.6 * F.least("skip_count", F.lit(4))
    return text.clamp(capped / 2) * scoring.half_life("last_played_at", now, 700)


_HOT = f"{_HEAT} * power(0.5, ({ORDERS_NOW} - last_played_at) / 86400.0 / 700)"


@query("F20_heat", f"SELECT user_id, track_id, round({_HOT}, 6) AS heat FROM interactions", plays)
def _(i):
    return i.select("user_id", "track_id", heat().alias("heat"))


@query("ST15_hottest", f"SELECT user_id, arg_max(track_id, (round({_HOT}, 9), track_id)) AS track_id FROM interactions GROUP BY user_id", plays)
def _(i):
    return i.groupBy("user_id").agg(F.max_by("track_id", F.struct(F.round(heat(), 9), "track_id")).alias("track_id"))


_LAST = "plays AS (SELECT user_id, track_id, max(ts) FILTER (event_type = 'play_start') AS last_play, max(ts) FILTER (event_type = 'dislike') AS last_no FROM listen_events GROUP BY ALL), ignored AS (SELECT e.user_id, e.track_id, count(*) AS shown FROM listen_events e JOIN plays p USING (user_id, track_id) WHERE e.event_type = 'reco_impression' AND e.ts > coalesce(p.last_play, 0) GROUP BY ALL)"


def gate(e: DataFrame) -> DataFrame:
    """user_id, track_id, last_play, last_no, shown: impressions since the last play."""
    when = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    last = e.groupBy("user_id", "track_id").agg(when("play_start").alias("last_play"), when("dislike").alias("last_no"))
    shown = e.filter("event_type = 'reco_impression'").join(last, ["user_id", "track_id"]).filter(F.col("ts") > F.coalesce("last_play", F.lit(0))).groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias("shown"))
    return last.join(shown, ["user_id", "track_id"], "left")


@query("ST13_ignore_gate", f"{_LAST} SELECT user_id, track_id, coalesce(shown, 0) AS shown, coalesce(shown, 0) >= 3 AS ignored FROM plays LEFT JOIN ignored USING (user_id, track_id)", events)
def _(e):
    shown = F.coalesce("shown", F.lit(0))
    return gate(e).select("user_id", "track_id", shown.alias("shown"), (shown >= 3).alias("ignored"))


@query("ST14_resurfacing", f"{_LAST} SELECT user_id, track_id, CASE WHEN last_no IS NOT NULL AND last_no >= coalesce(last_play, 0) THEN 'suppressed' WHEN coalesce(shown, 0) >= 3 THEN 'ignored' WHEN last_play >= {NOW} - 86400 * 7 THEN 'confirmed' WHEN last_play IS NOT NULL THEN 'candidate' ELSE 'none' END AS stage FROM plays LEFT JOIN ignored USING (user_id, track_id)", events)
def _(e):
    no = F.col("last_no").isNotNull() & (F.col("last_no") >= F.coalesce("last_play", F.lit(0)))
    stage = F.when(no, "suppressed").when(F.coalesce("shown", F.lit(0)) >= 3, "ignored").when(F.col("last_play") >= NOW - 86400 * 7, "confirmed").when(F.col("last_play").isNotNull(), "candidate").otherwise("none")
    return gate(e).select("user_id", "track_id", stage.alias("stage"))


@query("ST11_repeat_cooldown", f"SELECT user_id, track_id, count(*) AS serves, round(greatest(1 - least(sum(power(0.5, ({NOW} - ts) / 3600.0 / 180)) / 3, 1) * 0.5, 0.5), 6)::DOUBLE AS factor FROM listen_events WHERE event_type = 'reco_impression' AND ts >= {NOW} - 3600 * 480 GROUP BY ALL", events)
def _(e):
    """Served often of late: down to half."""
    served = e.filter("event_type = 'reco_impression'").filter(F.col("ts") >= NOW - 3600 * 480)
    load = F.sum(F.pow(F.lit(0.5), (NOW - F.col("ts")) / 3600.0 / 180)) / 3
    return served.groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias("serves"), F.greatest(1 - F.least(load, F.lit(1.0)) * 0.5, F.lit(0.5)).alias("factor"))


# History and charts

_PLAYED = "starts AS (SELECT * FROM listen_events WHERE event_type = 'play_start'), ends AS (SELECT * FROM listen_events WHERE event_type = 'play_end'), by_session AS (SELECT user_id, session_id, track_id, arg_max(value, ts * 1000000 + id) AS session_value FROM ends WHERE session_id IS NOT NULL GROUP BY ALL)"


@query("J12_session_key_join", "ends AS (SELECT session_id, track_id, arg_max(value, ts * 1000000 + id) AS completion FROM listen_events WHERE event_type = 'play_end' AND session_id IS NOT NULL GROUP BY ALL) SELECT id, round(completion, 6) AS completion FROM listen_events JOIN ends USING (session_id, track_id) WHERE event_type = 'play_start'", events)
def _(e):
    """The completion that the latest end of a start's session and track tells."""
    ends = e.filter("event_type = 'play_end' AND session_id IS NOT NULL").groupBy("session_id", "track_id").agg(F.max_by("value", F.struct("ts", "id")).alias("completion"))
    return e.filter("event_type = 'play_start'").join(ends, ["session_id", "track_id"]).select("id", "completion")


@query("D31_listening_history", f"{_PLAYED} SELECT s.id, s.track_id, title, round(coalesce(session_value, (SELECT arg_min(n.value, n.ts * 1000000 + n.id) FROM ends n WHERE n.user_id = s.user_id AND n.track_id = s.track_id AND (n.ts, n.id) > (s.ts, s.id))), 6) AS completion FROM starts s LEFT JOIN by_session b USING (user_id, session_id, track_id) LEFT JOIN track_features t ON t.track_id = s.track_id", events, tracks)
def _(e, t):
    return sessions.play_history(e).join(t.select("track_id", "title"), "track_id", "left").select("id", "track_id", "title", "completion")


@query("D32_recommendation_history", "SELECT i.id, i.request_id, i.track_id, title, EXISTS (SELECT 1 FROM listen_events s WHERE s.event_type IN ('play_start', 'play_end') AND s.request_id = i.request_id AND s.track_id = i.track_id) AS streamed FROM listen_events i LEFT JOIN track_features t ON t.track_id = i.track_id WHERE i.event_type = 'reco_impression' AND i.user_id IN ('u1', 'u2', 'u3')", events, tracks)
def _(e, t):
    shown = e.filter("event_type = 'reco_impression' AND user_id IN ('u1', 'u2', 'u3')")
    flagged = linking.with_flag(shown, e.filter("event_type IN ('play_start', 'play_end')"), ["request_id", "track_id"], "streamed")
    return flagged.join(t.select("track_id", "title"), "track_id", "left").select("id", "request_id", "track_id", "title", "streamed")


@query("J03_playlist_tracks", "lists AS (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS position FROM listen_events WHERE event_type = 'playlist_add') SELECT user_id, position, track_id, title FROM lists LEFT JOIN track_features USING (track_id)", events, tracks)
def _(e, t):
    lists = e.filter("event_type = 'playlist_add'").withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("id")).cast("long"))
    return lists.join(t.select("track_id", "title"), "track_id", "left").orderBy("user_id", "position").select("user_id", "position", "track_id", "title")


@query("J09_dictionary_join", "SELECT id, track_id, title FROM listen_events JOIN track_features USING (track_id) WHERE event_type = 'like'", events, tracks)
def _(e, t):
    """Only the liked tracks are looked up."""
    liked = e.filter("event_type = 'like'").select("id", "track_id")
    return liked.join(t.join(liked, "track_id", "left_semi").select("track_id", "title"), "track_id")


@query("J14_latest_of_charts", "SELECT scope, entry, position FROM chart_entries c WHERE snapshot_date = (SELECT max(snapshot_date) FROM chart_entries d WHERE d.scope = c.scope)", c.chart_entries)
def _(ch):
    last = ch.groupBy("scope").agg(F.max("snapshot_date").alias("snapshot_date"))
    return ch.join(F.broadcast(last), ["scope", "snapshot_date"], "left_semi").select("scope", "entry", "position")


@query("W13_chart_delta", "SELECT n.scope, n.entry, n.position, o.position - n.position AS change FROM chart_entries n LEFT JOIN chart_entries o ON o.scope = n.scope AND o.entry = n.entry AND o.snapshot_date = n.snapshot_date - INTERVAL 3 MONTH WHERE n.snapshot_date >= DATE '1997-01-01'", c.chart_entries)
def _(ch):
    old = ch.select("scope", "entry", F.add_months("snapshot_date", 3).alias("snapshot_date"), F.col("position").alias("old"))
    return ch.filter("snapshot_date >= DATE '1997-01-01'").join(old, ["scope", "entry", "snapshot_date"], "left").select("scope", "entry", "position", (F.col("old") - F.col("position")).alias("change"))


@query("W14_position_history", "SELECT snapshot_date, scope, position FROM chart_entries WHERE entry = (SELECT min(entry) FROM chart_entries) ORDER BY snapshot_date, scope", c.chart_entries)
def _(ch):
    one = ch.agg(F.min("entry").alias("entry"))
    return ch.join(F.broadcast(one), "entry", "left_semi").orderBy("snapshot_date", "scope").select("snapshot_date", "scope", "position")


@query("D33_chart_page", "now AS (SELECT scope, max(snapshot_date) AS d FROM chart_entries WHERE snapshot_date <= DATE '1996-06-15' GROUP BY scope), old AS (SELECT scope, max(snapshot_date) AS d FROM chart_entries WHERE snapshot_date <= DATE '1996-03-15' GROUP BY scope) SELECT c.scope, c.entry, c.position, o.position - c.position AS change, u.c_name AS name FROM chart_entries c JOIN now ON now.scope = c.scope AND now.d = c.snapshot_date LEFT JOIN old ON old.scope = c.scope LEFT JOIN chart_entries o ON o.scope = c.scope AND o.snapshot_date = old.d AND o.entry = c.entry LEFT JOIN customer u ON u.c_custkey = c.entry", c.chart_entries, lambda s, d: c.read(s, d, "customer"))
def _(ch, u):
    """A chart as of a day, against that of three months before, with what is known of each entry."""
    now = linking.latest_as_of(ch, F.lit("1996-06-15").cast("date"), ["scope"])
    old = linking.latest_as_of(ch, F.lit("1996-03-15").cast("date"), ["scope"]).select("scope", "entry", F.col("position").alias("old"))
    return now.join(old, ["scope", "entry"], "left").join(u.select(F.col("c_custkey").alias("entry"), F.col("c_name").alias("name")), "entry", "left").select("scope", "entry", "position", (F.col("old") - F.col("position")).alias("change"), "name")


@query("A32_chart_stats", "last AS (SELECT c.* FROM chart_entries c WHERE snapshot_date = (SELECT max(snapshot_date) FROM chart_entries d WHERE d.scope = c.scope)) SELECT count(*) AS entries, round(avg(CASE WHEN entry % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS match_rate, count(DISTINCT scope) AS charts, count(DISTINCT snapshot_date) AS dates FROM last", c.chart_entries)
def _(ch):
    last = ch.join(F.broadcast(ch.groupBy("scope").agg(F.max("snapshot_date").alias("snapshot_date"))), ["scope", "snapshot_date"], "left_semi")
    return last.agg(F.count(F.lit(1)).alias("entries"), F.avg(F.when(F.col("entry") % 2 == 0, 1.0).otherwise(0.0)).alias("match_rate"), F.countDistinct("scope").alias("charts"), F.countDistinct("snapshot_date").alias("dates"))


@query("J27_genres_of_user", "SELECT genre, satisfaction FROM interactions JOIN track_features USING (track_id) WHERE user_id = 'u1' ORDER BY satisfaction DESC, track_id LIMIT 100".replace("SELECT genre, satisfaction", "SELECT genre, round(satisfaction, 6) AS satisfaction"), plays, tracks)
def _(i, t):
    return i.filter("user_id = 'u1'").join(t.select("track_id", "genre"), "track_id").orderBy(F.desc("satisfaction"), "track_id").limit(100).select("genre", "satisfaction")


@query("X15_liked_artists_and_genres", "best AS (SELECT user_id, artist, genre FROM interactions JOIN track_features USING (track_id) WHERE satisfaction > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY satisfaction DESC, track_id) <= 200), g AS (SELECT user_id, trim(unnest(string_split(genre, ','))) AS g FROM best) SELECT user_id, (SELECT list_sort(list(DISTINCT artist)) FROM best b WHERE b.user_id = u.user_id) AS artists, (SELECT list_sort(list(DISTINCT g)) FROM g WHERE g.user_id = u.user_id) AS genres FROM (SELECT DISTINCT user_id FROM best) u", plays, tracks)
def _(i, t):
    best = scoring.top_per(i.filter("satisfaction > 0"), ["user_id"], [F.desc("satisfaction"), F.col("track_id")], 200).join(t.select("track_id", "artist", "genre"), "track_id")
    genres = F.transform(F.split("genre", ","), lambda x: F.trim(x))
    return best.groupBy("user_id").agg(F.array_sort(F.collect_set("artist")).alias("artists"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(genres)))).alias("genres"))


@query("D34_dashboard", f"SELECT (SELECT count(*) FROM listen_events) AS events, (SELECT count(DISTINCT user_id) FROM listen_events) AS users, (SELECT count(*) FROM track_features) AS tracks, (SELECT count(*) FROM listen_events WHERE ts >= {NOW} - 86400) AS today, (SELECT count(*) FROM track_features WHERE analysis_error IS NULL) AS analysed", events, tracks)
def _(e, t):
    log = e.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("ts") >= NOW - 86400).alias("today"))
    return log.join(t.agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("analysis_error").isNull()).alias("analysed")))


@query("D35_session_stats", f"{_ROLLED} SELECT count(*) AS sessions, round(avg(seconds), 6) AS seconds, round(avg(plays), 6) AS plays, max(events) AS longest, (SELECT count(DISTINCT user_id) FROM interactions) AS scored_users FROM s", events, plays)
def _(e, i):
    s = sessions.rollup(e).agg(F.count(F.lit(1)).alias("sessions"), F.avg("duration_s").alias("seconds"), F.avg("plays").alias("plays"), F.max("events").alias("longest"))
    return s.join(i.agg(F.countDistinct("user_id").alias("scored_users")))


@query("W09_recent_sessions", f"{SESSIONS}, last AS (SELECT user_id, session_no, dense_rank() OVER (PARTITION BY user_id ORDER BY session_no DESC) AS r, track_id, ts, id FROM numbered) SELECT user_id, list(track_id ORDER BY ts, id)[-50:] AS recent FROM last WHERE r <= 5 GROUP BY user_id", events)
def _(e):
    """The last fifty tracks of the last five sessions."""
    recent = sessions.split(e).withColumn("r", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("session_no")))).filter("r <= 5")
    lists = scoring.top_per(recent, ["user_id"], [F.desc("ts"), F.desc("id")], 50).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "track_id"))).alias("x"))
    return lists.select("user_id", F.col("x.track_id").alias("recent"))


@query("W08_album_representatives", "best AS (SELECT track_id, max(satisfaction) AS s FROM interactions GROUP BY track_id) SELECT album, track_id, n FROM (SELECT album, track_id, row_number() OVER (PARTITION BY album ORDER BY coalesce(CASE WHEN track_number % 2 = 0 THEN energy END, s, 0) DESC, track_id)::INT AS n FROM track_features LEFT JOIN best USING (track_id)) WHERE n <= 5", tracks, plays)
def _(t, i):
    best = i.groupBy("track_id").agg(F.max("satisfaction").alias("s"))
    score = F.coalesce(F.when(F.col("track_number") % 2 == 0, F.col("energy")), F.col("s"), F.lit(0.0))
    return scoring.top_per(t.join(best, "track_id", "left"), ["album"], [score.desc(), F.col("track_id")], 5).select("album", "track_id", F.col("rank").alias("n"))


@query("W06_top_tracks_per_user", "SELECT user_id, track_id, n FROM (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY satisfaction DESC, track_id)::INT AS n FROM interactions) WHERE n <= 50", plays)
def _(i):
    return scoring.top_per(i, ["user_id"], [F.desc("satisfaction"), F.col("track_id")], 50).select("user_id", "track_id", F.col("rank").alias("n"))


@query("W21_time_split", "SELECT min(ts) + (0.8 * (max(ts) - min(ts)))::BIGINT AS cut FROM listen_events".replace("(0.8 * (max(ts) - min(ts)))::BIGINT", "floor(0.8 * (max(ts) - min(ts)))::BIGINT"), events)
def _(e):
    return e.agg((F.min("ts") + F.floor(0.8 * (F.max("ts") - F.min("ts")))).alias("cut"))


@query("W22_training_windows", f"{SESSIONS} SELECT user_id, session_no, track_id AS next, len(before) AS seen FROM (SELECT user_id, session_no, track_id, list(track_id) OVER (PARTITION BY user_id, session_no ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM numbered) WHERE len(before) >= 2", events)
def _(e):
    w = Window.partitionBy("user_id", "session_no").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return sessions.split(e).withColumn("before", F.collect_list("track_id").over(w)).filter(F.size("before") >= 2).select("user_id", "session_no", F.col("track_id").alias("next"), F.size("before").cast("long").alias("seen"))


# Vectors

_UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
_V = f"units AS (SELECT track_id, {_UNIT.format('v')} AS u FROM track_vectors)"


@query("F30_cosines", f"{_V} SELECT a.track_id, round(list_dot_product(a.u, b.u), 6) AS cosine FROM units a, units b WHERE b.track_id = 'p7'", c.track_vectors)
def _(v):
    seed = v.filter("track_id = 'p7'").select(F.col("v").alias("q"))
    return v.join(F.broadcast(seed)).select("track_id", vectors.cosine(F.col("v"), F.col("q")).alias("cosine"))


@query("F31_centred", "long AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS nth FROM track_vectors), centre AS (SELECT list(m ORDER BY nth) AS c FROM (SELECT nth, avg(x) AS m FROM long GROUP BY nth)), moved AS (SELECT track_id, list_transform(range(1, len(v) + 1), lambda k: v[k] - c[k]) AS d FROM track_vectors, centre) SELECT track_id, round(d[1] / sqrt(list_dot_product(d, d)), 6) AS head FROM moved", c.track_vectors)
def _(v):
    return vectors.centred(v).select("track_id", F.element_at("v", 1).alias("head"))


@query("F32_arc", f"{_V}, two AS (SELECT a.u AS a, b.u AS b, acos(least(greatest(list_dot_product(a.u, b.u), -1), 1)) AS angle FROM units a, units b WHERE a.track_id = 'p1' AND b.track_id = 'p7') SELECT k::INT AS at, round((sin(0.75 * angle) * a[k] + sin(0.25 * angle) * b[k]) / sin(angle), 6) AS x FROM two, range(1, 65) r(k)", c.track_vectors)
def _(v):
    one = lambda k, n: v.filter(F.col("track_id") == k).select(text.unit(F.col("v")).alias(n))
    both = one("p1", "a").join(one("p7", "b"))
    return both.select(F.posexplode(vectors.between(F.col("a"), F.col("b"), 0.25)).alias("at", "x")).select((F.col("at") + 1).alias("at"), "x")


_MEAN = "long AS (SELECT {keys}, unnest(v) AS x, generate_subscripts(v, 1) AS nth FROM {rows}), means AS (SELECT {keys}, list(m ORDER BY nth) AS m FROM (SELECT {keys}, nth, avg(x) AS m FROM long GROUP BY ALL) GROUP BY {keys})"


@query("A20_centroids", _MEAN.format(keys="label", rows="track_vectors") + " SELECT label, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS head, round(m[64] / sqrt(list_dot_product(m, m)), 6) AS tail FROM means", c.track_vectors)
def _(v):
    return vectors.mean(v, ["label"]).select("label", F.element_at("v", 1).alias("head"), F.element_at("v", -1).alias("tail"))


@query("A21_session_means", f"{SESSIONS}, own AS (SELECT DISTINCT user_id, session_no, track_id FROM numbered), many AS (SELECT user_id, session_no, v, count(*) OVER (PARTITION BY user_id, session_no) AS n FROM own JOIN track_vectors USING (track_id)), " + _MEAN.format(keys="user_id, session_no", rows="(SELECT * FROM many WHERE n >= 2)") + " SELECT user_id, session_no, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS head FROM means", events, c.track_vectors)
def _(e, v):
    own = sessions.split(e).select("user_id", "session_no", "track_id").distinct().join(v.select("track_id", "v"), "track_id")
    many = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "session_no"))).filter("n >= 2")
    return vectors.mean(many, ["user_id", "session_no"]).select("user_id", "session_no", F.element_at("v", 1).alias("head"))


@query("T06_nearest", f"{_V} SELECT a.track_id, round(list_dot_product(a.u, b.u), 6) AS score FROM units a, units b WHERE b.track_id = 'p7' AND a.track_id NOT IN ('p7', 'p8') ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, a.track_id LIMIT 20", c.track_vectors)
def _(v):
    return vectors.nearest(v, v.filter("track_id = 'p7'"), 20, v.filter("track_id IN ('p7', 'p8')"))


@query("D29_similar_tracks", f"{_V}, near AS (SELECT a.track_id, round(list_dot_product(a.u, b.u), 9) AS score FROM units a, units b WHERE b.track_id = 'p7' AND a.track_id != 'p7' ORDER BY 2 DESC, 1 LIMIT 15) SELECT near.track_id, round(score, 6) AS score, title FROM near LEFT JOIN track_features t ON t.track_id = near.track_id", c.track_vectors, tracks)
def _(v, t):
    seed = v.filter("track_id = 'p7'")
    return vectors.nearest(v, seed, 15, seed).join(t.select("track_id", "title"), "track_id", "left")


@query("D30_text_search", f"{_V} SELECT a.track_id, round(list_dot_product(a.u, b.u), 6) AS score FROM units a, units b WHERE b.track_id = 'p3' ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, a.track_id LIMIT 10", c.track_vectors)
def _(v):
    """Tracks by likeness to the vector of a text, here one of the table's."""
    return vectors.nearest(v, v.filter("track_id = 'p3'"), 10)


@query("E07_diversity", f"{_V}, lists AS (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY satisfaction DESC, track_id) AS n FROM interactions JOIN units USING (track_id)), top AS (SELECT user_id, n, u FROM lists JOIN units USING (track_id) WHERE n <= 10) SELECT a.user_id, round(avg(1 - list_dot_product(a.u, b.u)), 6) AS diversity FROM top a JOIN top b ON a.user_id = b.user_id AND a.n < b.n GROUP BY a.user_id", plays, c.track_vectors)
def _(i, v):
    top = scoring.top_per(i.join(v.select("track_id", text.unit(F.col("v")).alias("u")), "track_id"), ["user_id"], [F.desc("satisfaction"), F.col("track_id")], 10)
    a, b = (top.select("user_id", F.col("rank").alias(f"r{x}"), F.col("u").alias(x)) for x in "ab")
    return a.join(b, "user_id").filter("ra < rb").groupBy("user_id").agg(F.avg(1 - text.dot(F.col("a"), F.col("b"))).alias("diversity"))


@query("D47_music_map", "SELECT track_id, round(v[1], 6) AS x, round(v[2], 6) AS y, list_sort(list_transform(mood_tags, lambda m: {'c': m.confidence, 'l': m.label}))[-1].l AS mood FROM track_features JOIN track_vectors USING (track_id)", tracks, c.track_vectors)
def _(t, v):
    mood = F.array_max(F.transform("mood_tags", lambda m: F.struct(m["confidence"], m["label"].alias("label"))))["label"]
    return t.join(v, "track_id").select("track_id", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"), mood.alias("mood"))
