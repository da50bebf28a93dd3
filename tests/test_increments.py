"""Increments, sinks, duplicates and radio: repeated writes change nothing, streams give the rows of their batch folds."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import ingest, radio
from cadenza.plans import canonical
from cadenza.sources import sinks
from cadenza.streaming import accepted, increments, radio as radio_stream

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def shown(table, spark):
    return plain(table.read(spark).withColumn("days", F.hll_sketch_estimate("days")))


def test_increments_equal_one_run(spark, tmp_path):
    """Three increments, one repeated and folds at any time, are one full run, sketches included."""
    log = increments.with_day(canonical.listen_events(spark, SF)).cache()
    whole = increments.track_signals(f"file://{tmp_path}/whole")
    assert whole.read(spark) is None
    whole.add(log, 0)
    own = increments.track_signals(f"file://{tmp_path}/own")
    for b in range(3):
        own.add(log.filter(F.col("id") % 3 == b), b)
        if b == 1:
            own.fold(spark)
            own.add(log.filter(F.col("id") % 3 == 0), 0)  # held by the base already
    assert shown(own, spark) == shown(whole, spark)
    own.add(log.filter(F.col("id") % 3 == 2), 2)
    assert shown(own, spark) == shown(whole, spark)
    own.fold(spark)
    own.fold(spark)
    assert shown(own, spark) == shown(whole, spark)
    exact = log.groupBy("user_id", "track_id").agg(F.count_if(F.col("event_type") == "play_start").alias("plays"), F.countDistinct("day").alias("days"))
    assert plain(own.read(spark).select("user_id", "track_id", "plays", F.hll_sketch_estimate("days").alias("days"))) == plain(exact)


def test_half_written_base_is_not_read(spark, tmp_path):
    log = increments.with_day(canonical.listen_events(spark, SF)).cache()
    table = increments.track_signals(f"file://{tmp_path}/t")
    table.add(log, 0)
    before = shown(table, spark)
    log.limit(3).write.parquet(f"{tmp_path}/t/base-0")  # no marker names it
    os.makedirs(f"{tmp_path}/t/delta/batch=1")  # a batch that was never finished
    assert shown(table, spark) == before


def test_stream_of_increments(spark, tmp_path):
    """A stream in files, some of them repeated by a second run, gives the table of the whole log."""
    log = canonical.listen_events(spark, SF)
    log.repartition(5).write.parquet(f"{tmp_path}/in")
    table = increments.track_signals(f"file://{tmp_path}/table")
    for _ in range(2):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        table.follow(increments.with_day(stream), f"{tmp_path}/state", fold_every=2).awaitTermination()
    whole = increments.track_signals(f"file://{tmp_path}/whole")
    whole.add(increments.with_day(log), 0)
    assert shown(table, spark) == shown(whole, spark)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_sinks_touch_what_they_write(spark, tmp_path):
    at = f"file://{tmp_path}/days"
    rows = spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("x"), F.concat(F.lit("2024-01-0"), (F.col("id") % 5 + 1).cast("string")).alias("day"))
    sinks.replace_parts(rows, at, "day")
    before = files(f"{tmp_path}/days")
    sinks.replace_parts(rows.filter("day = '2024-01-03'").withColumn("x", F.lit(-1).cast("long")), at, "day")
    after = files(f"{tmp_path}/days")
    assert {f for f in before if "01-03" not in f} == {f for f in after if "01-03" not in f} and all(before[f] == after[f] for f in before if f in after)
    assert plain(sinks.read(spark, at, rows)) == plain(rows.withColumn("x", F.when(F.col("day") == "2024-01-03", -1).otherwise(F.col("x"))))
    assert sinks.retain(spark, at, "day", "2024-01-03") == ["2024-01-01", "2024-01-02"] and sinks.retain(spark, at, "day", "2024-01-03") == []
    assert sinks.parts(spark, at, "day") == ["2024-01-03", "2024-01-04", "2024-01-05"]
    assert {r.day for r in sinks.read(spark, at, rows).collect()} == {"2024-01-03", "2024-01-04", "2024-01-05"}


def test_append_is_idempotent(spark, tmp_path):
    at = f"file://{tmp_path}/audit"
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 1), (3, "d", 2)], "id long, x string, day int")
    sinks.append_new(rows, at, ["id"], "day")
    sinks.append_new(rows.withColumn("x", F.lit("again")).unionByName(spark.createDataFrame([(4, "e", 2)], "id long, x string, day int")), at, ["id"], "day")
    assert plain(sinks.read(spark, at, rows)) == [(1, "a", 1), (2, "b", 1), (3, "d", 2), (4, "e", 2)]


def greedy(rows, window):
    """ids of accepted events, one by one."""
    last, out = {}, set()
    for id_, user, track, kind, ts in sorted(rows, key=lambda r: (str(r[1]), str(r[2]), str(r[3]), r[4], r[0])):
        if (user, track, kind) not in last or ts - last[user, track, kind] > window:
            last[user, track, kind] = ts
            out.add(id_)
    return out


KIND = "id long, user_id string, track_id string, event_type string, ts long"


@pytest.mark.parametrize(("window", "n"), [(2, 600), (7, 600), (30, 200)])
def test_greedy_duplicates_over_many_ranges(spark, window, n):
    """Random keys, hot ones and nulls, in more ranges than keys."""
    rng = np.random.default_rng(window)
    rows = [(k, None if u == 9 else f"u{u // 8}", None if u == 3 else "t", "skip", int(t)) for k, (u, t) in enumerate(zip(rng.integers(0, 10, n).tolist(), rng.integers(0, 400, n).tolist(), strict=True))]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = ingest.accepted_times(spark.createDataFrame(rows, KIND).repartition(3), window).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(made) == n and {r.id for r in made if r.accepted} == greedy(rows, window)


def test_a_run_of_very_many_close_events(spark):
    """One key's hundred thousand events, a second apart: every third stands, whatever ranges they fall in."""
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run = spark.range(100_000).select("id", F.lit("u").alias("user_id"), F.lit("t").alias("track_id"), F.lit("skip").alias("event_type"), F.col("id").alias("ts"))
        got = ingest.accepted_times(run).filter("accepted").agg(F.count(F.lit(1)), F.sum((F.col("id") % 3 != 0).cast("int"))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tuple(got) == (33_334, 0)
    assert ingest.accepted_times(run.limit(0)).count() == 0


@pytest.fixture
def stateful(spark):
    for k, v in radio_stream.needed_conf().items():
        spark.conf.set(k, v)
    yield spark
    for k in radio_stream.needed_conf():
        spark.conf.unset(k)


def in_files(spark, df, folder, n):
    """df in n files by time, which a stream reads one by one, and a last event that moves the watermark on."""
    rows = df.orderBy("ts", "id").collect()
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.parquet(f"{folder}/{k:02}")
    for k in (n, n + 1):
        end = {f.name: None for f in df.schema.fields} | {"id": -k, "user_id": f"end{k}", "track_id": "end", "event_type": "like", "ts": rows[-1].ts + 86400 * 30 * (k - n + 1)}
        spark.createDataFrame([tuple(end[f.name] if f.name != "dial" else 0.3 for f in df.schema.fields)], df.schema).coalesce(1).write.parquet(f"{folder}/{k:02}")


def streamed(spark, folder, schema, delay="1 second"):
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return raw.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", delay)


def emitted(df, folder):
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")


def test_stream_of_accepted_events(stateful, tmp_path):
    spark = stateful
    rng = np.random.default_rng(4)
    rows = [(k, f"u{k % 3}", "t", "skip", None, 1000 + int(t)) for k, t in enumerate(sorted(rng.integers(0, 300, 400).tolist()))]  # an event at time 0 is late from the start
    df = spark.createDataFrame(rows, "id long, user_id string, track_id string, event_type string, value double, ts long")
    in_files(spark, df, f"{tmp_path}/in", 4)
    got = emitted(accepted.accepted(streamed(spark, f"{tmp_path}/in", df.schema)), tmp_path)
    assert {r.id for r in got.collect() if r.id >= 0} == greedy([(r[0], r[1], r[2], r[3], r[5]) for r in rows], 2)


def radio_events(spark):
    rng = np.random.default_rng(6)
    kinds = ["play_start", "like", "skip", "dislike", "pause"]
    rows, ts = [], 0
    for k in range(260):
        ts += int(rng.choice([30, 600, 5000, 14400, 14401, 40000], p=[0.5, 0.2, 0.1, 0.05, 0.05, 0.1]))
        rows.append((k, f"u{rng.integers(0, 2)}", f"t{rng.integers(0, 9)}", kinds[int(rng.choice(5, p=[0.5, 0.2, 0.15, 0.1, 0.05]))], ts, float(rng.choice([0.0, 0.3, 1.0]))))
    return spark.createDataFrame(rows, "id long, user_id string, track_id string, event_type string, ts long, dial double")


def library(spark):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(f"t{k}", rng.normal(size=3).tolist()) for k in range(7)], "track_id string, v array<double>")


def close(rows):
    return sorted(((r.user_id, r.last_active, r.feedback, tuple(r.heard), None if r.v is None else tuple(round(x, 9) for x in r.v)) for r in rows), key=str)


def test_radio_stream_equals_the_fold(stateful, tmp_path):
    """Sessions over several batches, ended by timers and by late events, are those of the batch."""
    spark = stateful
    events = radio_events(spark)
    in_files(spark, events, f"{tmp_path}/in", 5)
    got = emitted(radio_stream.ended(streamed(spark, f"{tmp_path}/in", events.schema), library(spark)), tmp_path).filter("user_id NOT LIKE 'end%'").collect()
    want = radio.fold(events, library(spark), F.col("dial")).collect()
    assert close(got) == close(want) and len(want) > 20


def test_radio_fold_one_by_one(spark):
    """Likes pull and dislikes push as a plain loop does; the dial scales; no vector, no drift."""
    events = radio_events(spark)
    vectors = {r.track_id: np.array(r.v) / np.linalg.norm(r.v) for r in library(spark).collect()}
    want, state = [], {}

    def finish(user):
        s = state.pop(user)
        v = s["base"]
        if v is not None and s["moved"] is not None:
            v = v + 0.3 * max(0, 1 + s["dial"] - 0.3) * s["moved"]
            v = v / np.linalg.norm(v)
        want.append((user, s["last"], s["n"], tuple(s["heard"][-50:]), None if v is None else tuple(round(float(x), 9) for x in v)))

    for r in events.orderBy("ts", "id").collect():
        if r.event_type == "pause":
            continue
        if r.user_id in state and r.ts - state[r.user_id]["last"] > radio.TTL_S:
            finish(r.user_id)
        s = state.setdefault(r.user_id, {"base": None, "moved": None, "n": 0, "heard": []})
        s["last"], s["dial"], v = r.ts, r.dial, vectors.get(r.track_id)
        if r.event_type == "play_start":
            s["heard"].append(r.track_id)
            s["base"] = v if s["base"] is None else s["base"]
        else:
            s["n"] += 1
            s["moved"] = None if s["moved"] is None else 0.9 * s["moved"]
            if v is not None:
                s["moved"] = (0 if s["moved"] is None else s["moved"]) + {"like": 1.5, "dislike": -0.5, "skip": -0.25}[r.event_type] * v
    for user in list(state):
        finish(user)
    assert close(radio.fold(events, library(spark), F.col("dial")).collect()) == sorted(want, key=str)
