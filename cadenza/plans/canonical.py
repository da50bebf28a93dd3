"""The library's canonical tables, derived from the star-schema tables and the event stream.

listen_events comes from events, track_features from part, interactions from the
orders and lineitem of a customer, chart_entries from monthly totals. Each has
the same definition as DuckDB SQL in CTES, which the checking SQL starts with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Listening events that stand for each kind of event, by turns of the event id.
TYPES = {
    "view": ("reco_impression", "play_start", "play_start"), "click": ("play_end",), "purchase": ("like", "playlist_add"),
    "signup": ("skip", "skip", "queue_add"), "error": ("dislike", "seek_back", "pause", "pause"),
}
#: "Now" for all decays: the end of the event log, and of the orders.
NOW, ORDERS_NOW = 1706659200, 1009843200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))) for k, names in TYPES.items()])
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("track_id"),
        kind.alias("event_type"),
        F.when(F.col("event_type") == "click", F.least(F.col("value") / 100.0, F.lit(1.0))).alias("value"),
        F.floor(ms / 1000000).cast("long").alias("ts"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("s"), (F.col("event_id") % 97).cast("string"))).alias("session_id"),
        F.element_at(F.array(*map(F.lit, ("home", "search", "radio", "recommend_api"))), (F.col("event_id") % 4 + 1).cast("int")).alias("surface"),
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 10).cast("long").cast("string")).alias("request_id"),
        F.floor(F.col("value") * 1000).cast("long").alias("dwell_ms"),
        F.element_at(F.array(*map(F.lit, ("phone", "car", "speaker"))), (F.col("event_id") % 3 + 1).cast("int")).alias("device_type"),
        (F.col("event_id") % 50).cast("int").alias("position"),
        F.hour(F.col("ts")).alias("hour_of_day"),
    )


def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    mood = lambda label, n: F.struct(F.lit(label).alias("label"), ((k % n) / float(n)).alias("confidence"))
    return p.select(
        F.concat(F.lit("p"), k.cast("string")).alias("track_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.concat_ws(" ", "p_brand", "p_type").alias("album"),
        F.concat_ws(", ", F.lower("p_type"), F.split("p_name", " ")[0]).alias("genre"),
        (k % 20 + 1).cast("int").alias("track_number"),
        (60.0 + F.col("p_size") * 2).alias("bpm"),
        ((k % 100) / 100.0).alias("energy"),
        ((k % 89) / 89.0).alias("danceability"),
        ((k % 83) / 83.0).alias("valence"),
        F.element_at(F.array(*map(F.lit, KEYS)), (k % 12 + 1).cast("int")).alias("key"),
        F.when(k % 2 == 0, "major").otherwise("minor").alias("mode"),
        F.floor(F.col("p_retailprice") * 200).cast("long").alias("duration_ms"),
        F.array(mood("happy", 10), mood("sad", 7), mood("calm", 13)).alias("mood_tags"),
        F.concat(F.lit("/music/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/"), k.cast("string"), F.lit(".mp3")).alias("file_path"),
        (k % 3).cast("int").alias("analysis_version"),
        F.when(k % 17 == 0, "decode").alias("analysis_error"),
    )


#: Plays that one task joins and sums up, about: beyond them per partition of a shuffle there are more partitions than Spark's setting, so that a task's memory stays as it is.
TASK_ROWS = 250_000


def interactions(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> DataFrame:
    o, l = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem")
    l = l.select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity", "l_discount", "l_shipdate")
    parts = -(-l.count() // task_rows)
    many = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    if many:
        o, l = o.repartition(parts, "o_orderkey"), l.repartition(parts, "l_orderkey")
    name = lambda letter, n: F.concat(F.lit(letter), F.col(n).cast("string"))
    joined = o.join(l, o.o_orderkey == l.l_orderkey).withColumn("user_id", name("u", "o_custkey"))
    # by user, as most sums over interactions are, so that these need no shuffle of their own
    joined = joined.repartition(parts, "user_id") if many else joined.repartition("user_id")
    made = joined.groupBy("user_id", "l_partkey").agg(
        F.count(F.lit(1)).alias("play_count"),
        F.count_if(F.col("l_returnflag") == "A").alias("like_count"),
        F.count_if(F.col("l_returnflag") == "R").alias("skip_count"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10)).alias("early_skip_count"),
        F.count_if((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 45)).alias("dislike_count"),
        F.round(F.avg(F.col("l_discount")) * 10, 6).alias("satisfaction"),
        F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("last_played_at"),
        F.min(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("first_played_at"),
    )
    return made.select("user_id", name("p", "l_partkey").alias("track_id"), *made.columns[2:])


def chart_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders")
    month = F.date_trunc("month", F.col("o_orderdate")).cast("date")
    totals = o.groupBy(month.alias("snapshot_date"), F.col("o_orderpriority").alias("scope"), F.col("o_custkey").alias("entry")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("snapshot_date", "scope").orderBy(F.desc("score"), "entry"))
    return totals.withColumn("position", rank).filter("position <= 10")


def similar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, track_id, score: tracks on neighbouring lines of an order, as an outside service would relate them."""
    l = read(spark, sf_dir, "lineitem")
    after = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("other"))
    pairs = l.join(after, ["l_orderkey", "l_linenumber"])
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    return pairs.groupBy(name("l_partkey").alias("source"), name("other").alias("track_id")).agg((F.max("l_discount") * 10).alias("score"))


def track_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, v (doubles), label: the embedded part of the library."""
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("track_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


_K = ", ".join(f"'{k}'" for k in KEYS)
_KINDS = " ".join(f"WHEN '{k}' THEN {list(names)}[event_id % {len(names)} + 1]" for k, names in TYPES.items())
CTES = f"""
listen_events AS (SELECT event_id AS id, 'u' || user_id AS user_id, 'p' || (props->>'k') AS track_id,
  CASE event_type {_KINDS} END AS event_type,
  CASE WHEN event_type = 'click' THEN least(value / 100.0, 1.0) END AS value, floor(epoch_us(ts) / 1000000)::BIGINT AS ts,
  CASE WHEN event_id % 5 != 0 THEN 's' || (event_id % 97) END AS session_id, ['home', 'search', 'radio', 'recommend_api'][event_id % 4 + 1] AS surface,
  'r' || (event_id // 10) AS request_id, floor(value * 1000)::BIGINT AS dwell_ms, ['phone', 'car', 'speaker'][event_id % 3 + 1] AS device_type,
  (event_id % 50)::INT AS position, hour(ts)::INT AS hour_of_day FROM events),
track_features AS (SELECT 'p' || p_partkey AS track_id, p_name AS title, p_brand AS artist, p_brand || ' ' || p_type AS album,
  lower(p_type) || ', ' || split_part(p_name, ' ', 1) AS genre, (p_partkey % 20 + 1)::INT AS track_number, 60.0::DOUBLE + p_size * 2 AS bpm,
  (p_partkey % 100) / 100.0::DOUBLE AS energy, (p_partkey % 89) / 89.0::DOUBLE AS danceability, (p_partkey % 83) / 83.0::DOUBLE AS valence,
  [{_K}][p_partkey % 12 + 1] AS key, CASE WHEN p_partkey % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, floor(p_retailprice * 200)::BIGINT AS duration_ms,
  [{{'label': 'happy', 'confidence': (p_partkey % 10) / 10.0::DOUBLE}}, {{'label': 'sad', 'confidence': (p_partkey % 7) / 7.0::DOUBLE}}, {{'label': 'calm', 'confidence': (p_partkey % 13) / 13.0::DOUBLE}}] AS mood_tags,
  '/music/' || p_brand || '/' || p_type || '/' || p_partkey || '.mp3' AS file_path, (p_partkey % 3)::INT AS analysis_version,
  CASE WHEN p_partkey % 17 = 0 THEN 'decode' END AS analysis_error FROM part),
interactions AS (SELECT 'u' || o_custkey AS user_id, 'p' || l_partkey AS track_id, count(*) AS play_count, count_if(l_returnflag = 'A')::BIGINT AS like_count,
  count_if(l_returnflag = 'R')::BIGINT AS skip_count, count_if(l_returnflag = 'R' AND l_quantity < 10)::BIGINT AS early_skip_count,
  count_if(l_returnflag = 'N' AND l_quantity > 45)::BIGINT AS dislike_count, round(avg(l_discount) * 10, 6) AS satisfaction,
  max(epoch_us(l_shipdate) // 1000000) AS last_played_at, min(epoch_us(l_shipdate) // 1000000) AS first_played_at
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
chart_entries AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, scope ORDER BY score DESC, entry)::INT AS position FROM
  (SELECT date_trunc('month', o_orderdate)::DATE AS snapshot_date, o_orderpriority AS scope, o_custkey AS entry, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS score FROM orders GROUP BY ALL)) WHERE position <= 10),
similar_edges AS (SELECT 'p' || a.l_partkey AS source, 'p' || b.l_partkey AS track_id, max(a.l_discount) * 10 AS score FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL),
track_vectors AS (SELECT 'p' || vec_id AS track_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)
"""
