"""The sequence models: gradients, causality, and held-out gains on planted sequences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import attention, recurrent


def numeric(model, loss, name, at, step=1e-5):
    w = model.p[name]
    kept = w[at]
    w[at] = kept + step
    up = loss()
    w[at] = kept - step
    down = loss()
    w[at] = kept
    return (up - down) / (2 * step)


def test_attention_gradients():
    model = attention.Model(7, width=8, heads=2, blocks=2, longest=5, seed=3)
    rows = np.array([[0, 0, 1, 2, 3, 4], [5, 6, 7, 1, 1, 2], [0, 3, 3, 5, 2, 7]])
    _, g = model.loss(rows)
    rng = np.random.default_rng(0)
    for name, d in g.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in d.shape)
            if name == "E" and at[0] == 0:
                continue  # the filler is not learnt
            assert d[at] == pytest.approx(numeric(model, lambda: model.loss(rows)[0], name, at), rel=1e-3, abs=1e-7), name


def test_attention_is_causal_and_ignores_fillers():
    model = attention.Model(9, width=8, heads=2, blocks=2, longest=6)
    a, b = np.array([[1, 2, 3, 4, 5, 6]]), np.array([[1, 2, 3, 9, 9, 9]])
    assert np.allclose(model.forward(a)[0][:, :3], model.forward(b)[0][:, :3])
    filled = np.array([[0, 0, 0, 4, 5, 6]])
    other = model.forward(filled)[0][:, 3:]
    model.p["E"][0] += 5.0
    assert np.allclose(model.forward(filled)[0][:, 3:], other)


def test_recurrent_gradients():
    rng = np.random.default_rng(1)
    model = recurrent.Network(4, state=5)
    x, there = rng.normal(size=(3, 6, 4)), np.ones((3, 6))
    there[1, 4:], x[1, 4:] = 0, 0
    _, g = model.loss(x, there)
    for name, d in g.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in d.shape)
            assert d[at] == pytest.approx(numeric(model, lambda: model.loss(x, there)[0], name, at), rel=1e-3, abs=1e-8), name


def chains(spark, users: int = 120, length: int = 24):
    """Users who walk a circle of sixty tracks by steps of one or two from places of their own; one popular track between."""
    u = spark.range(users).select(F.col("id").alias("u")).crossJoin(spark.range(length).select(F.col("id").alias("k")))
    step = F.col("k") + F.floor(F.col("k") / 3)
    track = F.when(F.col("k") % 6 == 5, F.lit("hit")).otherwise(F.concat(F.lit("t"), ((F.col("u") * 7 + step) % 60).cast("string")))
    return u.select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("user_id"), track.alias("track_id"), F.lit("play_start").alias("event_type"), (F.col("k") * 60 + F.col("u")).alias("ts"), (F.col("u") * length + F.col("k")).alias("id"))


def test_next_track_beats_popularity(spark):
    plays = attention.played(chains(spark, length=22))
    r = attention.held_out(plays, k=3, width=32, heads=2, blocks=1, epochs=40).first()
    assert r.users == 120 and r.hits >= 0.7 * r.users and r.hits > r.popular_hits + 0.4 * r.users


def test_predictions_of_every_user(spark):
    events = chains(spark, 20, 10).unionByName(spark.createDataFrame([("new", "never seen", "play_start", 1, -1), ("odd", None, "play_start", 1, -2)], "user_id string, track_id string, event_type string, ts long, id long"))
    plays = attention.played(events)
    trained = attention.train(plays.filter("user_id != 'new'"), width=16, heads=2, blocks=1, epochs=2)
    rows = attention.predict(trained, plays, 5).collect()
    assert {r.user_id for r in rows} == {f"u{k}" for k in range(20)} and len(rows) == 100
    for u in ("u0", "u7"):
        own = sorted((r.rank, r.score) for r in rows if r.user_id == u)
        assert [k for k, _ in own] == [1, 2, 3, 4, 5] and [s for _, s in own] == sorted((s for _, s in own), reverse=True)
    assert attention.train(plays.limit(0)) is None


def turning(spark, users: int = 60, n: int = 12):
    """Session vectors that turn by a fixed angle from session to session, from a place of each user's own."""
    u = spark.range(users).select(F.col("id").alias("u")).crossJoin(spark.range(n).select(F.col("id").alias("session_no")))
    angle = F.col("u") * 0.37 + F.col("session_no") * 0.6
    return u.select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("user_id"), "session_no", F.array(F.cos(angle), F.sin(angle), F.lit(0.1)).alias("v"))


def test_next_session_beats_the_last(spark):
    r = recurrent.held_out(turning(spark), epochs=80).first()
    assert r.users == 60 and r.cosine > r.baseline + 0.1 and r.cosine > 0.95


def test_drift_of_every_user(spark):
    made = turning(spark, 12, 5)
    network = recurrent.train(made, epochs=60)
    rows = recurrent.predict(network, made).collect()
    assert len(rows) == 12 and all(abs(np.linalg.norm(r.v) - 1) < 1e-9 and 0 <= r.drift <= 2 for r in rows)
    assert recurrent.train(made.filter("session_no < 2")) is None
