"""Picks of an album's credits, which must not compare every track with every credit."""

from __future__ import annotations

import random

from cadenza.plans import matching


def library(spark, n=400):
    rng = random.Random(8)
    names = ["x", "X", " x ", "y", None]
    tracks = [(f"p{k}", rng.choice(["a", "b", "lone"]), rng.choice(["m", "n"]), rng.choice("xyz"), rng.choice([None, *range(0, 900_000, 1000)])) for k in range(n)]
    credits = [(f"s{rng.choice([k, k + 3_000_000])}", rng.choice(["a", "b", "other"]), rng.choice(["M", "n", "q", None]), rng.choice(names), rng.randrange(900)) for k in range(n)]
    t = spark.createDataFrame(tracks, "track_id string, album string, artist string, title string, duration_ms long")
    return tracks, credits, t, spark.createDataFrame(credits, "server_id string, album string, artist string, title string, duration long")


def albums(tracks, credits):
    return [(t, own) for t in tracks if (own := [c for c in credits if c[1] == t[1]])]


def test_first_by_tier(spark):
    tracks, credits, t, x = library(spark)

    def tier(a, c):
        same = c[2] is not None and c[2].lower() == a[2].lower()
        return 0 if same and c[3] is not None and c[3].strip().lower() == a[3].lower() else 1 if same else 2

    want = {(a[0], *min((tier(a, c), c[0]) for c in own)[::-1]) for a, own in albums(tracks, credits)}
    assert set(map(tuple, matching.tiered(t, x).collect())) == want


def test_closest_by_duration_and_number(spark):
    """Numbers beyond a million weigh as much as seconds, as in the SQL."""
    tracks, credits, t, x = library(spark)
    least = {}
    for a, own in albums(tracks, credits):
        costs = [] if a[4] is None else sorted((abs(c[4] - a[4] // 1000) * 1_000_000 + int(c[0][1:]), c[0]) for c in own)
        least[a[0]] = {s for k, s in costs if k == costs[0][0]} or {None}
    got = dict(map(tuple, matching.closest_duration(t, x).collect()))
    assert got.keys() == least.keys() and all(got[k] in least[k] for k in got)
