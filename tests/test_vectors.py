"""The nearest of all vectors by blocks, and radio lists where much was served."""

from __future__ import annotations

import numpy as np

from cadenza.operators import vectors
from cadenza.plans import playlists


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_best_of_blocks(spark):
    rng = np.random.default_rng(1)
    u, d = unit(rng.normal(size=(130, 8))), unit(rng.normal(size=(70, 8)))
    units = spark.createDataFrame([(f"p{k}", x.tolist()) for k, x in enumerate(u)], "track_id string, u array<double>")
    asked = spark.createDataFrame([(f"u{k}", x.tolist(), 1 + k * 3) for k, x in enumerate(d)], "user_id string, d array<double>, k long")
    got = {}
    for r in vectors.best_of_all(asked, units, 40, 30).collect():
        got.setdefault(r.user_id, []).append((-r.s, r.track_id))
    for k, own in enumerate(d @ u.T):
        most = min(1 + k * 3, 130)
        assert [t for _, t in sorted(got[f"u{k}"])[:most]] == [f"p{n}" for n in np.argsort(-own)[:most]]


def test_radio_where_most_is_served(spark):
    """Served tracks lose half at most; those that point away lose less than others."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    events, n = [], 0
    for user in range(6):
        for track, kind, times in [(user, "like", 1), (user + 9, "skip", 1)] + [(int(t), "reco_impression", int(rng.integers(1, 8))) for t in rng.permutation(60)[: 11 * user]]:
            for _ in range(times):
                n += 1
                events.append((n, f"u{user}", f"p{track}", kind, n))
    e = spark.createDataFrame(events, "id long, user_id string, track_id string, event_type string, ts long")
    v = spark.createDataFrame([(f"p{k}", y.tolist()) for k, y in enumerate(x)], "track_id string, v array<double>")
    want = set()
    for user in range(6):
        drift = 0.85 * x[user] - 0.5 * x[user + 9]
        s = unit(x) @ (drift / np.linalg.norm(drift))
        served = [sum(1 for _, u, t, kind, _ in events if (u, t, kind) == (f"u{user}", f"p{k}", "reco_impression")) for k in range(60)]
        score = [y * max(1 - c / 6, 0.5) for y, c in zip(s, served, strict=True)]
        want |= {(f"u{user}", f"p{k}", place) for place, k in enumerate(np.argsort(-np.array(score))[:10], 1)}
    assert set(map(tuple, playlists.radio_batch(e, v).collect())) == want
