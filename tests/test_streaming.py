"""Streams give the rows of their batch queries."""

from __future__ import annotations

from cadenza.plans import canonical
from cadenza.streaming import events

SF = "/root/testdata/sf0.001"


def source(spark, folder):
    """The log in three files, one of them twice, and a last event that moves the watermark past all others."""
    log = canonical.listen_events(spark, SF).select("id", "user_id", "track_id", "event_type", "value", "ts").cache()
    log.repartitionByRange(3, "ts").write.parquet(f"{folder}/a")
    end = log.agg({"ts": "max"}).first()[0] + 86400 * 9
    spark.createDataFrame([(-1, "end", "p0", "pause", None, end)], events.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/b")
    return log


def run(spark, made, folder):
    events.write(made, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_sessions_and_rates(spark, tmp_path):
    log = source(spark, str(tmp_path))
    stream = lambda: events.read(spark, f"{tmp_path}/*")
    batch = log.selectExpr("*", "timestamp_seconds(ts) AS time")
    for name in ("sessions", "rates"):
        make = getattr(events, name)
        got = run(spark, make(stream()), f"{tmp_path}/{name}")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, make(batch).collect()), key=str)


def test_duplicates(spark, tmp_path):
    log = source(spark, str(tmp_path))
    log.limit(50).write.parquet(f"{tmp_path}/c")
    got = run(spark, events.deduplicated(events.read(spark, f"{tmp_path}/*")).select("id"), f"{tmp_path}/d")
    assert sorted(r.id for r in got.collect()) == sorted([-1, *(r.id for r in log.collect())])
