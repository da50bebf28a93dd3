"""Queries that SQL cannot check, against plain computations on the smallest tables."""

from __future__ import annotations

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import registry
from cadenza.plans import canonical, matching

SF = "/root/testdata/sf0.001"
Q = registry.queries()


def rows(spark, name):
    return Q[name](spark, SF).collect()


def likeness(a, b):
    return difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio()


def test_best_matches(spark):
    """Every album against every hit: the scores that are kept, and the best of each album."""
    albums: dict = {}
    for r in canonical.track_features(spark, SF).select("artist", "album").collect():
        albums[r.artist, r.album] = albums.get((r.artist, r.album), 0) + 1
    hits = matching.credits(spark, SF).select("server_id", "artist", "album", "duration").collect()
    want = {}
    for (artist, album), n in albums.items():
        for h in hits:
            a, b = likeness(artist, h.artist), likeness(album, h.album)
            if a >= 0.85 and b >= 0.80:
                close = lambda x: max(1 - x / 5, 0)
                want[f"{artist}/{album}", h.server_id] = 0.5 * a + 0.4 * b + 0.05 * close(abs(n - h.duration % 12)) + 0.05 * close(h.duration % 3)
    got = {(r.target, r.server_id): r.score for r in rows(spark, "F11_match_score")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    best: dict = {}
    for (target, server), score in want.items():
        best[target] = min(best.get(target, (0, "")), (-round(score, 9), server))
    assert {r.target: r.server_id for r in rows(spark, "D43_best_match")} == {t: s for t, (_, s) in best.items()}


def test_decoded_vectors(spark):
    heads = {r.track_id: float(np.float32(r.v[0])) for r in canonical.track_vectors(spark, SF).collect()}
    got = {r.track_id: r.head for r in rows(spark, "F33_decoded_vectors")}
    assert got.keys() == heads.keys() and all(abs(got[k] - heads[k]) < 1e-5 for k in heads)


def test_map_of_tracks(spark):
    """The two principal components, up to their signs."""
    own = canonical.track_vectors(spark, SF).orderBy("track_id").collect()
    x = np.array([r.v for r in own])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    want = x @ axes.T
    placed = {r.track_id: (r.x, r.y) for r in rows(spark, "M07_map_of_tracks")}
    got = np.array([placed[r.track_id] for r in own])
    for k in (0, 1):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-4


def test_factorised_recommendations(spark):
    """Ten at most a user, best first, none of them played before."""
    played = {(r.user_id, r.track_id) for r in canonical.interactions(spark, SF).select("user_id", "track_id").collect()}
    own: dict = {}
    for r in rows(spark, "M01_implicit_als"):
        own.setdefault(r.user, []).append((r.item, r.score))
    assert own
    for user, found in own.items():
        assert len(found) <= 10 and not {(f"u{user}", f"p{i}") for i, _ in found} & played
    similar = rows(spark, "M01a_similar_items")
    assert len(similar) == 10 and all(-1 - 1e-6 <= r.score <= 1 + 1e-6 and r.item != 7 for r in similar)


def test_factorised_recommendations_of_every_user(spark, monkeypatch):
    """Each user has the ten best by the model's factors among all tracks that the user has not played."""
    from pyspark.ml.recommendation import ALS

    made, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: made.append(fit(self.setMaxIter(2), df)) or made[0])
    got: dict = {}
    for r in sorted(rows(spark, "M01_implicit_als"), key=lambda r: (r.user, -r.score, r.item)):
        got.setdefault(r.user, []).append((r.item, r.score))
    users, items = ({r.id: np.array(r.features, np.float32) for r in x.collect()} for x in (made[0].userFactors, made[0].itemFactors))
    played = {(int(r.user_id[1:]), int(r.track_id[1:])) for r in canonical.interactions(spark, SF).select("user_id", "track_id").collect()}
    assert got.keys() == users.keys() == {u for u, _ in played} and len(users) > 50
    for user, d in users.items():
        score = {i: float(d @ u) for i, u in items.items() if (user, i) not in played}
        best = sorted(score.values(), reverse=True)[:10]
        assert len(got[user]) == len({i for i, _ in got[user]}) == len(best) and all(abs(score[i] - s) < 1e-4 and abs(s - b) < 1e-4 for (i, s), b in zip(got[user], best, strict=True))


def test_best_others_in_blocks(spark):
    """Blocks of users and items change nothing; who has played nearly all gets what is left, equal scores go by item."""
    from cadenza.operators import vectors

    items = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "item int, u array<float>")
    heard = {1: [], 2: list(range(1, 40)), 3: list(range(0, 40, 2)), 4: [99, 4], 5: list(range(40))}
    asked = spark.createDataFrame([(u, [1.0, 0.5], p) for u, p in heard.items()], "user int, d array<float>, played array<int>")
    want = sorted((u, i) for u, p in heard.items() for i in sorted(set(range(40)) - set(p), key=lambda i: (-(i % 5), i))[:10])
    for sizes in ((100, 100), (7, 2)):
        assert sorted((r.user, r.item) for r in vectors.best_others(asked, items, 10, *sizes).collect()) == want


def test_no_runs_of_an_artist(spark):
    """A third of an artist in a row stands only where no other artist was left."""
    artist = {r.track_id: r.artist for r in canonical.track_features(spark, SF).select("track_id", "artist").collect()}
    own: dict = {}
    for r in rows(spark, "W16_no_runs_of_an_artist"):
        own.setdefault(r.user_id, []).append((r.spot, artist[r.track_id]))
    for found in own.values():
        names = [a for _, a in sorted(found)]
        assert [s for s, _ in sorted(found)] == list(range(1, len(found) + 1))
        for k in range(2, len(names)):
            assert not (names[k] == names[k - 1] == names[k - 2]) or set(names[k:]) == {names[k]}


def test_holdout_lifts(spark):
    r = rows(spark, "E02_model_holdout")[0]
    assert r.users > 100 and all(0 < x <= 1 for x in (r.ndcg, r.ndcg_50, r.random, r.popular))
    assert abs(r.lift_random - 100 * (r.ndcg / r.random - 1)) < 1e-2 and abs(r.lift_popular - 100 * (r.ndcg / r.popular - 1)) < 1e-2


def test_model_ranked_lists(spark):
    """At most ten of a user, at most two of an artist, no track that the user dislikes."""
    artist = {r.track_id: r.artist for r in canonical.track_features(spark, SF).select("track_id", "artist").collect()}
    banned = {(r.user_id, r.track_id) for r in canonical.interactions(spark, SF).filter(F.expr("dislike_count > 0 OR early_skip_count > 2")).collect()}
    own: dict = {}
    for r in rows(spark, "D16_ranked_by_model"):
        own.setdefault(r.user_id, []).append((r.slot, r.track_id))
    assert len(own) > 100
    for user, found in own.items():
        assert sorted(s for s, _ in found) == list(range(1, len(found) + 1)) and len(found) <= 10
        names = [artist[t] for _, t in found]
        assert len(found) < 10 or all(names.count(a) <= 2 for a in names)
        assert not {(user, t) for _, t in found} & banned


@pytest.mark.parametrize("name", ["M01_implicit_als", "M01a_similar_items"])
def test_factorisation_drops_its_shuffles(spark, monkeypatch, name):
    """Every round is checkpointed, so that no more than a few rounds' shuffles are on disk."""
    from pyspark.ml.recommendation import ALS

    used, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: used.append(self.getCheckpointInterval()) or fit(self.setMaxIter(1), df))
    registry.queries()[name](spark, SF)
    assert used == [1]
