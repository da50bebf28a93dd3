"""Scans, sinks and filters of the event log and the library."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..operators import ingest, linking, scoring
from ..sources import shared, sinks
from ..streaming import increments
from . import canonical as c
from .canonical import NOW, ORDERS_NOW
from .queries import SCORED, SESSIONS, query

_VALID = f"(ts BETWEEN {NOW} - 86400 AND {NOW} + 300 AND (value IS NULL OR value BETWEEN -1 AND 100000) AND hour_of_day BETWEEN 0 AND 23)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items with states, from orders: id, state, attempts, next_retry_at, updated_at, owner."""
    o = c.read(spark, sf_dir, "orders")
    state = F.element_at(F.array(*map(F.lit, ("pending", "in_flight", "complete", "failed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    updated = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("id"), state.alias("state"), (F.col("o_orderkey") % 7).cast("int").alias("attempts"), F.when(F.col("o_orderkey") % 3 != 0, updated + 86400 * 30).alias("next_retry_at"), updated.alias("updated_at"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("owner"), F.col("o_orderpriority").alias("service"))


TASKS = """tasks AS (SELECT o_orderkey AS id, ['pending', 'in_flight', 'complete', 'failed'][o_orderkey % 4 + 1] AS state, (o_orderkey % 7)::INT AS attempts,
  CASE WHEN o_orderkey % 3 != 0 THEN epoch_us(o_orderdate) // 1000000 + 86400 * 30 END AS next_retry_at, epoch_us(o_orderdate) // 1000000 AS updated_at, 'u' || o_custkey AS owner, o_orderpriority AS service FROM orders)"""


@query("S01_incremental_scan", "SELECT id, user_id, event_type, ts FROM listen_events WHERE id > 250 ORDER BY id LIMIT 5000", c.listen_events)
def _(e):
    return e.filter("id > 250").orderBy("id").limit(5000).select("id", "user_id", "event_type", "ts")


@query("S03_event_listing", "SELECT id, user_id, track_id, ts FROM listen_events WHERE user_id IS NOT NULL AND event_type = 'play_start' AND device_type = 'car' AND surface = 'search' AND session_id IS NOT NULL AND track_id IS NOT NULL ORDER BY ts DESC, id LIMIT 50 OFFSET 10", c.listen_events)
def _(e):
    wanted = {"event_type": "play_start", "device_type": "car", "surface": "search", "user_id": None, "session_id": None, "track_id": None}
    for column, value in wanted.items():
        e = e.filter(F.col(column).isNotNull() if value is None else F.col(column) == value)
    return e.orderBy(F.desc("ts"), "id").offset(10).limit(50).select("id", "user_id", "track_id", "ts")


_ACCEPT = """ok AS (SELECT * FROM listen_events WHERE {valid} AND NOT (event_type = 'play_end' AND coalesce(value, 1) < 0.05)),
kept AS (SELECT user_id, track_id, event_type, min(ts) AS ts FROM ok GROUP BY ALL
  UNION ALL SELECT o.user_id, o.track_id, o.event_type, min(o.ts) FROM kept k JOIN ok o ON o.user_id = k.user_id AND o.track_id = k.track_id AND o.event_type = k.event_type AND o.ts > k.ts + {window} GROUP BY o.user_id, o.track_id, o.event_type),
judged AS (SELECT e.*, CASE WHEN NOT e.fine THEN 'rejected' WHEN e.event_type = 'play_end' AND coalesce(e.value, 1) < 0.05 THEN 'noise' WHEN k.ts IS NULL THEN 'duplicate' ELSE 'accepted' END AS status
  FROM (SELECT *, {valid} AS fine FROM listen_events) e LEFT JOIN kept k ON k.user_id = e.user_id AND k.track_id = e.track_id AND k.event_type = e.event_type AND k.ts = e.ts)"""
_DAY = _ACCEPT.replace("{valid}", _VALID).replace("{window}", "2")
_MONTH = _ACCEPT.replace("{valid}", _VALID.replace("86400 AND", "86400 * 40 AND")).replace("{window}", "43200")


@query("S04_event_ingest", f"{_DAY} SELECT id, status FROM judged", c.listen_events)
def _(e):
    return ingest.judged(e, NOW).select("id", "status")


@query("S05_batch_ingest", f"{_DAY} SELECT id // 50 AS batch, count_if(status = 'accepted')::BIGINT AS accepted, count_if(status != 'accepted')::BIGINT AS rejected FROM judged GROUP BY ALL", c.listen_events)
def _(e):
    batch = F.floor(F.col("id") / 50).alias("batch")
    return ingest.judged(e, NOW).groupBy(batch).agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") != "accepted").alias("rejected"))


@query("S06_event_validation", f"SELECT id, {_VALID} AS valid FROM listen_events", c.listen_events)
def _(e):
    return e.select("id", ingest.valid(NOW).alias("valid"))


@query("P07_duplicate_window", f"{_MONTH} SELECT id, status FROM judged", c.listen_events)
def _(e):
    """The same with half a day for two seconds, so that chains of duplicates occur."""
    return ingest.judged(e, NOW, 86400 * 40, 43200).select("id", "status")


@query("ST03_late_data", f"SELECT id, ts < {NOW} - 86400 AS late, ts > {NOW} + 300 AS future FROM listen_events", c.listen_events)
def _(e):
    return e.select("id", (F.col("ts") < NOW - ingest.PAST_S).alias("late"), (F.col("ts") > NOW + ingest.FUTURE_S).alias("future"))


@query("ST04_idempotent_dedup", f"{_MONTH} SELECT user_id, track_id, event_type, count(*) AS kept FROM judged WHERE status = 'accepted' GROUP BY ALL", c.listen_events)
def _(e):
    kept = ingest.judged(e, NOW, 86400 * 40, 43200).filter("status = 'accepted'")
    return kept.groupBy("user_id", "track_id", "event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("ST02_progress_marker", "SELECT max(id) AS marker, count(*) AS pending FROM listen_events WHERE id > 500", c.listen_events)
def _(e):
    return e.filter("id > 500").agg(F.max("id").alias("marker"), F.count(F.lit(1)).alias("pending"))


@query("S07_analysed_library", "SELECT track_id, bpm FROM track_features JOIN track_vectors USING (track_id) WHERE analysis_error IS NULL AND v IS NOT NULL", c.track_features, c.track_vectors)
def _(t, v):
    return t.filter("analysis_error IS NULL").join(v.filter("v IS NOT NULL"), "track_id").select("track_id", "bpm")


@query("S08_embedding_scan", "SELECT track_id, len(v)::INT AS dims, round(v[1], 6) AS head FROM track_vectors", c.track_vectors)
def _(v):
    return v.select("track_id", F.size("v").alias("dims"), F.element_at("v", 1).alias("head"))


@query("S10_nested_projection", "SELECT event_id AS id, (props->>'k')::INT AS k, coalesce((props->>'absent')::INT, 0) AS absent, greatest(least((props->>'k')::INT / 50.0::DOUBLE, 1), 0) AS energy FROM events", lambda s, d: c.read(s, d, "events"))
def _(e):
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), k.alias("k"), F.coalesce(F.get_json_object("props", "$.absent").cast("int"), F.lit(0)).alias("absent"), text.clamp(k / 50.0).alias("energy"))


@query("S11_key_of_archive_path", "SELECT track_id, regexp_extract('dump/' || substr(sha256(track_id), 1, 8) || '-' || track_number || '.json', '([0-9a-f]{8})-[0-9]+\\.json$', 1) AS key FROM track_features", c.track_features)
def _(t):
    path = F.concat(F.lit("dump/"), F.substring(F.sha2("track_id", 256), 1, 8), F.lit("-"), F.col("track_number").cast("string"), F.lit(".json"))
    return t.select("track_id", F.regexp_extract(path, r"([0-9a-f]{8})-[0-9]+\.json$", 1).alias("key"))


@query("S13_change_detection", "SELECT track_id FROM track_features t WHERE NOT (sha256(file_path) = CASE WHEN track_number % 4 = 0 THEN 'old' ELSE sha256(file_path) END AND analysis_version = 2)", c.track_features)
def _(t):
    """Files are analysed again whose digest or analysis version differs from what is known."""
    known = t.select(F.col("file_path").alias("path"), F.when(F.col("track_number") % 4 == 0, "old").otherwise(F.sha2("file_path", 256)).alias("known"), F.col("analysis_version").alias("known_version"))
    same = (F.sha2("file_path", 256) == F.col("known")) & (F.col("known_version") == 2)
    return t.join(known, t["file_path"] == known["path"], "left").filter(~F.coalesce(same, F.lit(False))).select("track_id")


@query("S14_latest_wins_upsert", "SELECT track_id, CASE WHEN track_number % 3 = 0 THEN bpm + 1 ELSE bpm END AS bpm, CASE WHEN track_number % 3 = 0 THEN 9 ELSE analysis_version END::INT AS analysis_version FROM track_features", c.track_features)
def _(t):
    old = t.select("track_id", "bpm", "analysis_version")
    new = t.filter("track_number % 3 = 0").select("track_id", (F.col("bpm") + 1).alias("bpm"), F.lit(9).alias("analysis_version"))
    return ingest.newest_wins(old, new, ["track_id"], "analysis_version")


@query("S15_session_upsert", f"{SESSIONS}, s AS (SELECT user_id, session_no, max(id) AS event_id_max, count(*) AS events FROM numbered GROUP BY ALL) SELECT user_id, session_no, event_id_max + CASE WHEN session_no % 2 = 0 THEN 1 ELSE 0 END AS event_id_max, events + CASE WHEN session_no % 2 = 0 THEN 1 ELSE 0 END AS events FROM s", c.listen_events)
def _(e):
    """Sessions are replaced only by rows that saw a later event."""
    from ..operators import sessions

    now = sessions.split(e).groupBy("user_id", "session_no").agg(F.max("id").alias("event_id_max"), F.count(F.lit(1)).alias("events"))
    later = F.when(F.col("session_no") % 2 == 0, 1).otherwise(-1)
    return ingest.newest_wins(now, now.select("user_id", "session_no", (F.col("event_id_max") + later).alias("event_id_max"), (F.col("events") + later).alias("events")), ["user_id", "session_no"], "event_id_max")


@query("S16_user_upsert", f"SELECT user_id, min(ts) AS first_seen, greatest(max(ts), CASE WHEN length(user_id) % 2 = 0 THEN {NOW} ELSE 0 END) AS last_seen FROM listen_events GROUP BY user_id", c.listen_events)
def _(e):
    """Users seen again are touched, others stay."""
    old = e.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    again = old.filter(F.length("user_id") % 2 == 0).select("user_id", F.lit(NOW).cast("long").alias("first_seen"), F.lit(NOW).cast("long").alias("last_seen"))
    return old.unionByName(again).groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("S17_playlist_sink", "SELECT user_id, track_id, (row_number() OVER (PARTITION BY user_id ORDER BY satisfaction DESC, track_id) - 1)::INT AS position, least(count(*) OVER (PARTITION BY user_id), 20) AS size FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY satisfaction DESC, track_id) <= 20", c.interactions)
def _(i):
    """Playlists written by groups of users as a header and a track list, a group written again, and read back as positioned children."""
    spark, at = i.sparkSession, shared.path(i.sparkSession, "playlists")
    best = scoring.top_per(i, ["user_id"], [F.desc("satisfaction"), F.col("track_id")], 20)
    lists = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "track_id"))).alias("x")).withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(8)).cast("int"))
    made = lists.select("user_id", F.size("x").cast("long").alias("size"), F.col("x.track_id").alias("tracks"), "part")
    stale = made.filter("part = 3").withColumn("tracks", F.array(F.lit("stale")))
    sinks.replace_parts(made.filter("part != 3").unionByName(stale), at, "part")
    sinks.replace_parts(made.filter("part = 3"), at, "part")
    return sinks.read(spark, at, made).select("user_id", "size", F.posexplode("tracks").alias("position", "track_id"))


@query("S18_audit_sink", "SELECT request_id, min(id) AS id, count(*) AS n FROM listen_events GROUP BY request_id", c.listen_events)
def _(e):
    """Requests appended by day; those written twice stay as they were."""
    at = shared.path(e.sparkSession, "audits")
    audits = e.groupBy("request_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.floor(F.min("ts") / 86400).alias("day"))
    sinks.append_new(audits.filter("id % 20 < 12"), at, ["request_id"], "day")
    sinks.append_new(audits.withColumn("n", F.when(F.col("id") % 20 < 12, -1).otherwise(F.col("n"))), at, ["request_id"], "day")
    return sinks.read(e.sparkSession, at, audits).drop("day")


@query("S20_snapshot_sink", "SELECT snapshot_date, scope, entry, score, CASE WHEN snapshot_date = DATE '1998-01-01' THEN 0 ELSE position END::INT AS position FROM chart_entries WHERE snapshot_date != DATE '1998-01-01' OR position <= 5", c.chart_entries)
def _(ch):
    """A table of charts by day, of which one day is written anew; other days' files are not touched."""
    at = shared.path(ch.sparkSession, "charts")
    sinks.replace_parts(ch, at, "snapshot_date")
    sinks.replace_parts(ch.filter("snapshot_date = DATE '1998-01-01' AND position <= 5").withColumn("position", F.lit(0)), at, "snapshot_date")
    return sinks.read(ch.sparkSession, at, ch)


@query("S21_retention_purge", f"SELECT id, ts FROM listen_events WHERE ts >= {NOW} - 86400 * 10", c.listen_events)
def _(e):
    """Days before the last ten are dropped as folders."""
    spark, at = e.sparkSession, shared.path(e.sparkSession, "event-days")
    own = e.select("id", "ts", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day"))
    sinks.replace_parts(own, at, "day")
    sinks.retain(spark, at, "day", (datetime.fromtimestamp(NOW, UTC) - timedelta(days=10)).strftime("%Y-%m-%d"))
    return sinks.read(spark, at, own).select("id", "ts")


@query("S01_incremental_signals", "SELECT user_id, track_id, count_if(event_type = 'play_start')::BIGINT AS plays, count_if(event_type = 'like')::BIGINT AS likes, count_if(event_type = 'skip')::BIGINT AS skips, count_if(event_type = 'play_end' AND value >= 0.8)::BIGINT AS completed, max(ts) AS last_ts, min(ts) AS first_ts, max(id) AS last_id FROM listen_events GROUP BY ALL", c.listen_events)
def _(e):
    """Signals kept up to date by batches of ids: three increments, one of them added twice, and a fold between."""
    table = increments.track_signals(shared.path(e.sparkSession, "signals"))
    own = increments.with_day(e)
    batch = F.pmod(F.floor(F.col("id") / 5000), F.lit(3))
    table.add(own.filter(batch == 0), 0)
    table.add(own.filter(batch == 1), 1)
    table.fold(e.sparkSession)
    table.add(own.filter(batch == 1), 1)
    table.add(own.filter(batch == 2), 2)
    table.add(own.filter(batch == 2), 2)
    return table.read(e.sparkSession).drop("days")


@query("S22_purge_with_children", f"SELECT e.id, e.request_id FROM listen_events e WHERE request_id IN (SELECT request_id FROM listen_events GROUP BY request_id HAVING max(ts) >= {NOW} - 86400 * 10)", c.listen_events)
def _(e):
    kept = e.groupBy("request_id").agg(F.max("ts").alias("last")).filter(F.col("last") >= NOW - 86400 * 10)
    return e.join(kept, "request_id", "left_semi").select("id", "request_id")


@query("S25_config_versions", "SELECT user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY id) AS version, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) = 1 AS active FROM listen_events WHERE event_type = 'like'", c.listen_events)
def _(e):
    """Each save is the next version of its document and the one in force."""
    w = Window.partitionBy("user_id")
    return e.filter("event_type = 'like'").select(F.col("user_id").alias("name"), F.row_number().over(w.orderBy("id")).cast("long").alias("version"), (F.row_number().over(w.orderBy(F.desc("id"))) == 1).alias("active"))


@query("S27_id_remap", "SELECT user_id, CASE WHEN track_number % 5 = 0 THEN 'm' || track_number ELSE track_id END AS track_id, sum(play_count)::BIGINT AS play_count, max(last_played_at) AS last_played_at FROM interactions JOIN track_features USING (track_id) GROUP BY ALL", c.interactions, c.track_features)
def _(i, t):
    """Children follow a mapping of ids; rows that collide are merged."""
    mapping = t.filter("track_number % 5 = 0").select(F.col("track_id").alias("old"), F.concat(F.lit("m"), F.col("track_number").cast("string")).alias("new"))
    return ingest.remapped(i, mapping, "track_id").groupBy("user_id", "track_id").agg(F.sum("play_count").alias("play_count"), F.max("last_played_at").alias("last_played_at"))


@query("S28_user_rename", "SELECT 'event' AS kind, id::VARCHAR AS key, CASE WHEN user_id = 'u1' THEN 'renamed' ELSE user_id END AS user_id FROM listen_events UNION ALL SELECT 'session', min(id)::VARCHAR, CASE WHEN user_id = 'u1' THEN 'renamed' ELSE user_id END FROM listen_events WHERE session_id IS NOT NULL GROUP BY user_id, session_id UNION ALL SELECT 'interaction', track_id, CASE WHEN user_id = 'u1' THEN 'renamed' ELSE user_id END FROM interactions", c.listen_events, c.interactions)
def _(e, i):
    """The new name reaches events, sessions and interactions."""
    name = F.when(F.col("user_id") == "u1", "renamed").otherwise(F.col("user_id")).alias("user_id")
    session = e.filter("session_id IS NOT NULL").groupBy("user_id", "session_id").agg(F.min("id").alias("id"))
    parts = [e.select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("key"), name), session.select(F.lit("session").alias("kind"), F.col("id").cast("string").alias("key"), name), i.select(F.lit("interaction").alias("kind"), F.col("track_id").alias("key"), name)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("S29_stale_rows", "SELECT substr(sha256(file_path), 1, 16) AS id FROM track_features WHERE track_number % 6 = 0", c.track_features)
def _(t):
    """Rows whose id is a path's digest and whose file is gone."""
    rows = t.select(text.track_key(F.col("file_path")).alias("id")).unionByName(t.select(F.col("track_id").alias("id")))
    files = t.filter("track_number % 6 != 0").select(text.track_key(F.col("file_path")).alias("id"))
    return rows.filter(F.col("id").rlike("^[0-9a-f]{16}$")).join(files, "id", "left_anti")


@query("S30_rebuild", f"{SCORED} SELECT (SELECT count(*) FROM listen_events) AS events, (SELECT count(*) FROM signals) AS interactions, (SELECT count(DISTINCT user_id) FROM signals) AS users", c.listen_events)
def _(e):
    """All derived tables again from the raw log."""
    made = scoring.signals(e)
    return e.agg(F.count(F.lit(1)).alias("events")).join(made.agg(F.count(F.lit(1)).alias("interactions"), F.countDistinct("user_id").alias("users")))


@query("P01_track_list", "SELECT track_id, bpm, energy, count(*) OVER () AS total FROM track_features WHERE bpm BETWEEN 90 AND 140 AND energy >= 0.3 AND mode = 'major' AND key IN ('C', 'D', 'E', 'F#', 'G#', 'A#') ORDER BY bpm DESC, track_id LIMIT 20 OFFSET 5", c.track_features)
def _(t):
    found = t.filter(F.col("bpm").between(90, 140) & (F.col("energy") >= 0.3) & (F.col("mode") == "major") & F.col("key").isin("C", "D", "E", "F#", "G#", "A#"))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc("bpm"), "track_id").offset(5).limit(20).select("track_id", "bpm", "energy").join(F.broadcast(total))


@query("P02_text_filter", "SELECT track_id FROM track_features WHERE title ILIKE '%ring%' OR artist ILIKE '%#2%' OR album ILIKE '%promo%' OR genre ILIKE '%steel%' OR file_path ILIKE '%/99%'", c.track_features)
def _(t):
    wanted = {"title": "%ring%", "artist": "%#2%", "album": "%promo%", "genre": "%steel%", "file_path": "%/99%"}
    any_of = F.lit(False)
    for column, pattern in wanted.items():
        any_of = any_of | F.ilike(column, F.lit(pattern))
    return t.filter(any_of).select("track_id")


@query("P04_genre_filter", "SELECT track_id, genre FROM track_features WHERE contains(lower(genre), 'promo')", c.track_features)
def _(t):
    return t.filter(F.lower("genre").contains("promo")).select("track_id", "genre")


@query("P10_recently_skipped", f"SELECT user_id, track_id FROM interactions WHERE last_played_at >= {ORDERS_NOW} - 86400 * 1200 AND early_skip_count > 0", c.interactions)
def _(i):
    return i.filter((F.col("last_played_at") >= ORDERS_NOW - 86400 * 1200) & (F.col("early_skip_count") > 0)).select("user_id", "track_id")


@query("P13_require_interaction", "own AS (SELECT user_id, track_id, like_count > 0 AS liked, count_if(like_count > 0) OVER (PARTITION BY user_id) AS n FROM interactions) SELECT user_id, track_id FROM own WHERE liked OR n < 5", c.interactions)
def _(i):
    """Only liked tracks, but all of them where fewer than five would be left."""
    liked = F.col("like_count") > 0
    return i.withColumn("n", F.count_if(liked).over(Window.partitionBy("user_id"))).filter(liked | (F.col("n") < 5)).select("user_id", "track_id")


@query("P15_similar_by_features", "seed AS (SELECT * FROM track_features WHERE track_id = 'p7') SELECT t.track_id, t.bpm, t.energy FROM track_features t, seed s WHERE t.bpm BETWEEN s.bpm - 15 AND s.bpm + 15 AND t.energy BETWEEN greatest(s.energy - 0.25, 0) AND least(s.energy + 0.25, 1) AND t.mode = s.mode AND t.track_id != s.track_id ORDER BY abs(t.bpm - s.bpm), t.track_id LIMIT 20", c.track_features)
def _(t):
    s = t.filter("track_id = 'p7'").select(F.col("bpm").alias("b"), F.col("energy").alias("n"), F.col("mode").alias("m"))
    near = F.col("bpm").between(F.col("b") - 15, F.col("b") + 15) & F.col("energy").between(F.greatest(F.col("n") - 0.25, F.lit(0.0)), F.least(F.col("n") + 0.25, F.lit(1.0)))
    return t.join(F.broadcast(s), near & (F.col("mode") == F.col("m"))).filter("track_id != 'p7'").orderBy(F.abs(F.col("bpm") - F.col("b")), "track_id").limit(20).select("track_id", "bpm", "energy")


@query("P16_catalogue_search", "SELECT track_id, bpm, energy FROM track_features WHERE bpm BETWEEN 80 AND 150 AND energy BETWEEN 0.2 AND 0.9 AND key = 'C' AND genre LIKE '%promo%' AND track_id NOT IN ('p12', 'p24') ORDER BY bpm, track_id LIMIT 50", c.track_features)
def _(t):
    ranges = {"bpm": (80, 150), "energy": (0.2, 0.9)}
    wanted = [F.col(k).between(*r) for k, r in ranges.items()] + [F.col("key") == "C", F.col("genre").like("%promo%"), ~F.col("track_id").isin("p12", "p24")]
    for p in wanted:
        t = t.filter(p)
    return t.orderBy("bpm", "track_id").limit(50).select("track_id", "bpm", "energy")


_CALLS = "calls AS (SELECT page_id AS id, url AS path, ['GET', 'POST'][page_id % 2 + 1] AS method, CASE WHEN page_id % 11 = 0 THEN 500 ELSE 200 END AS status, page_id % 900 AS ms, 'u' || page_id % 7 AS user_id FROM pages)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of requests, from pages."""
    n = F.col("page_id")
    return c.read(spark, sf_dir, "pages").select(n.alias("id"), F.col("url").alias("path"), F.when(n % 2 == 0, "GET").otherwise("POST").alias("method"), F.when(n % 11 == 0, 500).otherwise(200).alias("status"), (n % 900).alias("ms"), F.concat(F.lit("u"), (n % 7).cast("string")).alias("user_id"))


@query("P17_call_log_filter", f"{_CALLS} SELECT id, path, status FROM calls WHERE method = 'GET' AND status < 500 AND user_id IN ('u1', 'u2', 'u4') AND ms BETWEEN 5 AND 800 AND path LIKE 'http%' AND path NOT LIKE '%/events%'", calls)
def _(x):
    return x.filter((F.col("method") == "GET") & (F.col("status") < 500) & F.col("user_id").isin("u1", "u2", "u4") & F.col("ms").between(5, 800) & F.col("path").like("http%") & ~F.col("path").like("%/events%")).select("id", "path", "status")


@query("P18_logged_paths", f"{_CALLS} SELECT id, path LIKE 'http%' AND NOT (path LIKE '%/health' OR path LIKE '%/static/%') AND method != 'OPTIONS' AS logged FROM calls", calls)
def _(x):
    quiet = F.col("path").like("%/health") | F.col("path").like("%/static/%")
    return x.select("id", (F.col("path").like("http%") & ~quiet & (F.col("method") != "OPTIONS")).alias("logged"))


@query("P19_short_tracks_on_the_road", "SELECT e.id, e.track_id FROM listen_events e JOIN track_features USING (track_id) WHERE NOT (device_type IN ('car', 'speaker') AND duration_ms < 190000)", c.listen_events, c.track_features)
def _(e, t):
    return e.join(t.select("track_id", "duration_ms"), "track_id").filter(~(F.col("device_type").isin("car", "speaker") & (F.col("duration_ms") < 190000))).select("id", "track_id")


@query("P20_anti_repetition", f"SELECT user_id, track_id FROM interactions WHERE last_played_at < {ORDERS_NOW} - 3600 * 24 * 1500", c.interactions)
def _(i):
    return i.filter(F.col("last_played_at") < ORDERS_NOW - 3600 * 24 * 1500).select("user_id", "track_id")


@query("P21_status_buckets", f"{TASKS} SELECT id, CASE WHEN upper(state) IN ('COMPLETE', 'DONE') THEN 'done' WHEN upper(state) IN ('PENDING', 'QUEUED') THEN 'waiting' WHEN upper(state) = 'IN_FLIGHT' THEN 'running' ELSE 'error' END AS bucket FROM tasks", tasks)
def _(x):
    s = F.upper("state")
    return x.select("id", F.when(s.isin("COMPLETE", "DONE"), "done").when(s.isin("PENDING", "QUEUED"), "waiting").when(s == "IN_FLIGHT", "running").otherwise("error").alias("bucket"))


@query("P22_lyrics_rule", "SELECT doc_id, CASE WHEN source IS NULL THEN 'none' WHEN n_chars < 100 THEN 'instrumental' WHEN length(text) > 0 THEN 'text' ELSE 'none' END AS shown FROM documents", lambda s, d: c.read(s, d, "documents"))
def _(d):
    return d.select("doc_id", F.when(F.col("source").isNull(), "none").when(F.col("n_chars") < 100, "instrumental").when(F.length("text") > 0, "text").otherwise("none").alias("shown"))


@query("P23_duration", "SELECT track_id, round(coalesce(CASE WHEN track_number % 2 = 0 THEN duration_ms / 1000 END, track_number * 10.0::DOUBLE), 6) AS duration FROM track_features", c.track_features)
def _(t):
    return t.select("track_id", F.coalesce(F.when(F.col("track_number") % 2 == 0, F.col("duration_ms") / 1000), F.col("track_number") * 10.0).alias("duration"))


@query("P24_scrobble_rule", "SELECT e.id FROM listen_events e JOIN track_features t USING (track_id) WHERE e.event_type IN ('play_end', 'play_start') AND duration_ms >= 30000 AND (coalesce(value >= 0.5, false) OR coalesce(CASE WHEN e.id % 2 = 0 THEN dwell_ms END >= 240000, false) OR coalesce(CASE WHEN e.id % 2 = 0 THEN dwell_ms END >= duration_ms / 2, false) OR (value IS NULL AND e.id % 2 = 1))", c.listen_events, c.track_features)
def _(e, t):
    """Half of the track or four minutes were heard; what has neither completion nor dwell counts."""
    dwell = F.when(F.col("id") % 2 == 0, F.col("dwell_ms"))
    heard = F.coalesce(F.col("value") >= 0.5, F.lit(False)) | F.coalesce(dwell >= 240000, F.lit(False)) | F.coalesce(dwell >= F.col("duration_ms") / 2, F.lit(False)) | (F.col("value").isNull() & dwell.isNull())
    return e.filter("event_type IN ('play_end', 'play_start')").join(t.select("track_id", "duration_ms"), "track_id").filter((F.col("duration_ms") >= 30000) & heard).select("id")


@query("P25_retry_eligible", f"{TASKS} SELECT id FROM tasks WHERE state IN ('pending', 'failed') AND attempts < 5 AND (next_retry_at IS NULL OR next_retry_at <= {ORDERS_NOW} - 86400 * 900)", tasks)
def _(x):
    return x.filter(ingest.eligible(ORDERS_NOW - 86400 * 900, 5)).select("id")


@query("P26_allow_and_deny", "SELECT track_id, artist FROM track_features WHERE lower(trim(artist)) IN ('brand#11', 'brand#12', 'brand#23', 'brand#34') AND lower(trim(artist)) NOT IN ('brand#12')", c.track_features)
def _(t):
    name = F.lower(F.trim("artist"))
    return t.filter(name.isin("brand#11", "brand#12", "brand#23", "brand#34") & ~name.isin("brand#12")).select("track_id", "artist")


@query("ST18_reaper", f"{TASKS} SELECT id, CASE WHEN state = 'in_flight' AND updated_at < {ORDERS_NOW} - 86400 * 700 THEN 'pending' ELSE state END AS state FROM tasks", tasks)
def _(x):
    stuck = (F.col("state") == "in_flight") & (F.col("updated_at") < ORDERS_NOW - 86400 * 700)
    return x.select("id", F.when(stuck, "pending").otherwise(F.col("state")).alias("state"))


@query("ST19_sweep_cursor", f"{TASKS} SELECT id, (row_number() OVER (ORDER BY id) - 1 + (SELECT count(*) FROM tasks WHERE state = 'pending') - 40) % (SELECT count(*) FROM tasks WHERE state = 'pending') AS turn FROM tasks WHERE state = 'pending' QUALIFY turn < 100", tasks)
def _(x):
    """A page of a queue from where the last sweep stopped, going round at its end."""
    from ..operators.ranking import numbered

    waiting = numbered(x.filter("state = 'pending'"), "id")
    total = waiting.agg(F.count(F.lit(1)).alias("n"))
    return waiting.join(F.broadcast(total)).select("id", ((F.col("place") + F.col("n") - 40) % F.col("n")).alias("turn")).filter("turn < 100")


@query("X05_state_by_outcome", f"{TASKS} SELECT id, CASE WHEN attempts = 0 THEN state WHEN attempts < 4 THEN 'complete' ELSE 'failed' END AS state, CASE WHEN attempts = 0 THEN updated_at ELSE {ORDERS_NOW} END AS updated_at FROM tasks", tasks)
def _(x):
    """A found result completes, a missing one fails, an error writes nothing."""
    error = F.col("attempts") == 0
    return x.select("id", F.when(error, F.col("state")).when(F.col("attempts") < 4, "complete").otherwise("failed").alias("state"), F.when(error, F.col("updated_at")).otherwise(F.lit(ORDERS_NOW)).alias("updated_at"))


@query("X08_exhausted", f"{TASKS} SELECT id, CASE WHEN state = 'failed' AND attempts >= 5 THEN 'exhausted' ELSE state END AS state FROM tasks", tasks)
def _(x):
    return x.select("id", F.when((F.col("state") == "failed") & (F.col("attempts") >= 5), "exhausted").otherwise(F.col("state")).alias("state"))


@query("X13_queue_order", f"{TASKS} SELECT id, attempts FROM tasks WHERE state = 'pending' ORDER BY attempts DESC, updated_at, id LIMIT 60", tasks)
def _(x):
    orders = {"attempts": [F.desc("attempts"), F.col("updated_at"), F.col("id")], "random": [F.rand(7)]}
    return x.filter("state = 'pending'").orderBy(*orders["attempts"]).limit(60).select("id", "attempts")


@query("X21_job_transitions", f"{TASKS} SELECT id, CASE WHEN state != 'in_flight' THEN state WHEN attempts >= 3 THEN 'complete' WHEN {ORDERS_NOW} - updated_at > 86400 * 1000 THEN 'failed' ELSE 'in_flight' END AS state FROM tasks", tasks)
def _(x):
    flying = F.col("state") == "in_flight"
    return x.select("id", F.when(~flying, F.col("state")).when(F.col("attempts") >= 3, "complete").when(ORDERS_NOW - F.col("updated_at") > 86400 * 1000, "failed").otherwise("in_flight").alias("state"))


@query("X22_queue_overview", f"{TASKS} (SELECT id, state FROM tasks WHERE state = 'in_flight' ORDER BY updated_at DESC, id LIMIT 20) UNION ALL (SELECT id, state FROM tasks WHERE state = 'pending' ORDER BY updated_at DESC, id LIMIT 20) UNION ALL (SELECT id, state FROM tasks WHERE state IN ('complete', 'failed') ORDER BY updated_at DESC, id LIMIT 20)".replace(") (SELECT", ") SELECT * FROM (SELECT", 1), tasks)
def _(x):
    part = lambda *states: x.filter(F.col("state").isin(*states)).orderBy(F.desc("updated_at"), "id").limit(20).select("id", "state")
    return part("in_flight").unionByName(part("pending")).unionByName(part("complete", "failed"))


@query("X23_listing_by_status", f"{TASKS} SELECT id, state, updated_at, count(*) OVER () AS total FROM tasks WHERE state = 'failed' ORDER BY updated_at DESC, id LIMIT 25", tasks)
def _(x):
    found = x.filter("state = 'failed'")
    return found.orderBy(F.desc("updated_at"), "id").limit(25).select("id", "state", "updated_at").join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query("X24_bulk_reset", f"{TASKS} SELECT id, CASE WHEN state IN ('failed', 'in_flight') THEN 'pending' ELSE state END AS state, CASE WHEN state IN ('failed', 'in_flight') THEN 0 ELSE attempts END AS attempts FROM tasks", tasks)
def _(x):
    hit = F.col("state").isin("failed", "in_flight")
    return x.select("id", F.when(hit, "pending").otherwise(F.col("state")).alias("state"), F.when(hit, 0).otherwise(F.col("attempts")).alias("attempts"))


@query("A29_count_by_status", f"{TASKS} SELECT service, count_if(state = 'pending')::BIGINT AS pending, count_if(state = 'in_flight')::BIGINT AS in_flight, count_if(state = 'complete')::BIGINT AS complete, count_if(state = 'failed')::BIGINT AS failed FROM tasks GROUP BY service", tasks)
def _(x):
    return x.groupBy("service").pivot("state", ["pending", "in_flight", "complete", "failed"]).count().na.fill(0)


@query("A40_latest_version_coverage", "SELECT artist, round(sum(CASE WHEN analysis_version = (SELECT max(analysis_version) FROM track_features) THEN 1 ELSE 0 END) / nullif(count(*), 0), 6) AS coverage FROM track_features GROUP BY artist", c.track_features)
def _(t):
    newest = t.agg(F.max("analysis_version").alias("newest"))
    return t.join(F.broadcast(newest)).groupBy("artist").agg(F.try_divide(F.count_if(F.col("analysis_version") == F.col("newest")), F.count(F.lit(1))).alias("coverage"))


@query("A31_coverage_with_stale", "SELECT least(count_if(analysis_version >= 1) / greatest(count(*), 1), 1.0::DOUBLE) AS coverage, count_if(analysis_version < 2)::BIGINT AS stale, count_if(analysis_error IS NOT NULL)::BIGINT AS failed FROM track_features", c.track_features)
def _(t):
    return t.agg(F.least(F.count_if(F.col("analysis_version") >= 1) / F.greatest(F.count(F.lit(1)), F.lit(1)), F.lit(1.0)).alias("coverage"), F.count_if(F.col("analysis_version") < 2).alias("stale"), F.count_if(F.col("analysis_error").isNotNull()).alias("failed"))


@query("A37_events_per_user", "SELECT user_id, id // 50 AS batch, count(*) AS n FROM listen_events GROUP BY ALL", c.listen_events)
def _(e):
    return e.groupBy("user_id", F.floor(F.col("id") / 50).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@query("A39_overall_status", "SELECT artist, CASE max(CASE WHEN analysis_error IS NOT NULL THEN 2 WHEN analysis_version < 2 THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status FROM track_features GROUP BY artist", c.track_features)
def _(t):
    worst = F.max(F.when(F.col("analysis_error").isNotNull(), 2).when(F.col("analysis_version") < 2, 1).otherwise(0))
    return t.groupBy("artist").agg(F.element_at(F.array(*map(F.lit, ("ok", "warn", "fail"))), worst + 1).alias("status"))


@query("A41_days_completed", f"{TASKS}, last AS (SELECT max(updated_at) // 86400 AS d FROM tasks WHERE state = 'complete'), days AS (SELECT unnest(range(d - 6, d + 1)) AS day FROM last) SELECT day, (SELECT count(*) FROM tasks WHERE state = 'complete' AND updated_at // 86400 = day) AS done FROM days", tasks)
def _(x):
    done = x.filter("state = 'complete'").select(F.floor(F.col("updated_at") / 86400).alias("day"))
    days = done.agg(F.max("day").alias("d")).select(F.explode(F.sequence(F.col("d") - 6, F.col("d"))).alias("day"))
    return days.join(done.groupBy("day").agg(F.count(F.lit(1)).alias("done")), "day", "left").na.fill(0)


@query("A42_remaining_capacity", f"SELECT 200 - count(*) AS left_over, ceil(count(*) / 200.0)::BIGINT AS hours FROM listen_events WHERE event_type = 'play_start' AND ts > {NOW} - 3600 * 24", c.listen_events)
def _(e):
    n = F.count(F.lit(1))
    return e.filter("event_type = 'play_start'").filter(F.col("ts") > NOW - 3600 * 24).agg((200 - n).alias("left_over"), F.ceil(n / 200.0).alias("hours"))


@query("ST07_sliding_capacity", "SELECT (ts // 300 - k) * 300 AS window_start, count(*) AS n FROM listen_events, range(12) r(k) WHERE event_type = 'play_start' GROUP BY ALL", c.listen_events)
def _(e):
    """Dispatches in each hour that begins at a multiple of five minutes."""
    hour = F.window(F.timestamp_seconds("ts"), "1 hour", "5 minutes")
    return e.filter("event_type = 'play_start'").groupBy(hour).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("window_start"), "n")


@query("ST05_ingest_rate", f"SELECT ts // 900 * 900 AS bucket, count(*) AS n FROM listen_events WHERE ts > {NOW} - 86400 GROUP BY ALL", c.listen_events)
def _(e):
    quarter = F.window(F.timestamp_seconds("ts"), "15 minutes")
    return e.filter(F.col("ts") > NOW - 86400).groupBy(quarter).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("bucket"), "n")


@query("ST01_session_window", "lagged AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 1800 THEN 0 ELSE 1 END AS fresh FROM listen_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS no FROM lagged) SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM numbered GROUP BY user_id, no", c.listen_events)
def _(e):
    """By Spark's session window: a gap of 1799 s on whole seconds parts where 1800 s or more pass."""
    made = e.groupBy("user_id", F.session_window(F.timestamp_seconds("ts"), "1799 seconds")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("events"))
    return made.select("user_id", "started_at", "ended_at", "events")


@query("T01_page_with_total", "SELECT id, ts, count(*) OVER () AS total FROM listen_events WHERE user_id = 'u1' ORDER BY ts DESC, id LIMIT 20 OFFSET 10", c.listen_events)
def _(e):
    own = e.filter("user_id = 'u1'")
    return own.orderBy(F.desc("ts"), "id").offset(10).limit(20).select("id", "ts").join(F.broadcast(own.agg(F.count(F.lit(1)).alias("total"))))


@query("T02_dynamic_sort", "SELECT track_id, energy FROM track_features ORDER BY energy DESC, track_id LIMIT 30", c.track_features)
def _(t):
    columns, wanted, direction = {"bpm", "energy", "title"}, "energy", "desc"
    column = F.col(wanted if wanted in columns else "title")
    return t.orderBy(column.desc() if direction == "desc" else column.asc(), "track_id").limit(30).select("track_id", "energy")


@query("T03_nulls_last", "SELECT id, value FROM listen_events ORDER BY value DESC NULLS LAST, id LIMIT 100 OFFSET 1", c.listen_events)
def _(e):
    return e.orderBy(F.desc_nulls_last("value"), "id").offset(1).limit(100).select("id", "value")


@query("T04_top_tracks_of_the_day", f"SELECT track_id, n, title, artist FROM (SELECT track_id, count(*) AS n FROM listen_events WHERE ts >= {NOW} - 86400 * 2 GROUP BY track_id ORDER BY n DESC, track_id LIMIT 10) LEFT JOIN track_features USING (track_id)", c.listen_events, c.track_features)
def _(e, t):
    top = e.filter(F.col("ts") >= NOW - 86400 * 2).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "track_id").limit(10)
    return top.join(t.select("track_id", "title", "artist"), "track_id", "left")


@query("T09_shown_first", "SELECT track_id, min(position) AS position, bool_or(event_type = 'reco_impression') AS shown FROM listen_events GROUP BY track_id ORDER BY shown DESC, position, track_id LIMIT 40", c.listen_events)
def _(e):
    return e.groupBy("track_id").agg(F.min("position").alias("position"), F.bool_or(F.col("event_type") == "reco_impression").alias("shown")).orderBy(F.desc("shown"), "position", "track_id").limit(40)


@query("T12_seeds", "SELECT track_id, sum(play_count)::BIGINT AS plays FROM interactions GROUP BY track_id ORDER BY plays DESC, track_id LIMIT 500", c.interactions)
def _(i):
    return i.groupBy("track_id").agg(F.sum("play_count").alias("plays")).orderBy(F.desc("plays"), "track_id").limit(500)


@query("X17_by_composite_keys", "SELECT user_id, track_id, play_count FROM interactions WHERE (user_id, track_id) IN (SELECT user_id, track_id FROM listen_events) OR (user_id = 'u1' AND track_id IS NOT NULL)", c.interactions, c.listen_events)
def _(i, e):
    asked = e.select("user_id", "track_id").unionByName(i.filter("user_id = 'u1'").select("user_id", "track_id")).distinct()
    return i.join(asked, ["user_id", "track_id"], "left_semi").select("user_id", "track_id", "play_count")


@query("X19_keyset_page", "SELECT id, ts FROM (SELECT id, ts FROM listen_events WHERE id > 300 ORDER BY id LIMIT 50)", c.listen_events)
def _(e):
    return e.filter("id > 300").orderBy("id").limit(50).select("id", "ts")


@query("X20_missing_embeddings", "SELECT track_id FROM track_features WHERE track_id NOT IN (SELECT track_id FROM track_vectors) AND analysis_error IS NULL", c.track_features, c.track_vectors)
def _(t, v):
    return t.filter("analysis_error IS NULL").join(v, "track_id", "left_anti").select("track_id")


@query("U09_distinct_scopes", "SELECT DISTINCT scope, year(snapshot_date)::INT AS year FROM chart_entries", c.chart_entries)
def _(ch):
    return ch.select("scope", F.year("snapshot_date").alias("year")).distinct()


@query("J04_users_with_event_counts", "SELECT 'u' || c_custkey AS user_id, count(id) AS events, max(ts) AS last_seen FROM customer LEFT JOIN listen_events ON user_id = 'u' || c_custkey GROUP BY ALL", lambda s, d: c.read(s, d, "customer"), c.listen_events)
def _(u, e):
    users = u.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"))
    return users.join(e.select("user_id", "id", "ts"), "user_id", "left").groupBy("user_id").agg(F.count("id").alias("events"), F.max("ts").alias("last_seen"))


@query("D17_empty_result", "SELECT 'u' || c_custkey AS user_id, CASE WHEN (SELECT count(*) FROM track_features) = 0 THEN 'no_library' WHEN NOT EXISTS (SELECT 1 FROM listen_events e WHERE e.user_id = 'u' || c_custkey) THEN 'no_history' WHEN NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = 'u' || c_custkey) THEN 'no_taste_profile' ELSE 'no_candidates' END AS reason FROM customer", lambda s, d: c.read(s, d, "customer"), c.listen_events, c.interactions, c.track_features)
def _(u, e, i, t):
    users = u.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"))
    flagged = linking.with_flag(linking.with_flag(users, e, ["user_id"], "heard"), i, ["user_id"], "scored")
    library = t.agg(F.count(F.lit(1)).alias("tracks"))
    reason = F.when(F.col("tracks") == 0, "no_library").when(~F.col("heard"), "no_history").when(~F.col("scored"), "no_taste_profile").otherwise("no_candidates")
    return flagged.join(F.broadcast(library)).select("user_id", reason.alias("reason"))


@query("D48_embedding_coverage", "SELECT count(*) AS tracks, count(v)::BIGINT AS embedded, round(count(v) / greatest(count(*), 1), 6) AS coverage FROM track_features LEFT JOIN track_vectors USING (track_id)", c.track_features, c.track_vectors)
def _(t, v):
    n, have = F.count(F.lit(1)), F.count("v")
    return t.join(v, "track_id", "left").agg(n.alias("tracks"), have.alias("embedded"), (have / F.greatest(n, F.lit(1))).alias("coverage"))
