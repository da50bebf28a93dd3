"""Sources of candidates whose work must not grow with the product of users and tracks."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.operators import ivf, ranking, recommending
from cadenza.plans import canonical as c, recommend

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [recommend.SENT_BLOCKS, 0])
def test_folders_of_several_blocks(spark, most):
    """Users who have heard the leading tracks of a folder get later ones; a track of two folders counts once."""
    rng = random.Random(3)
    tracks = [(f"p{k}", f"/m/{'abc'[min(k // 150, 2)]}/{k}.mp3") for k in range(320)] + [("p7", "/m/b/again.mp3"), ("p5000", "/m/d/x.mp3"), ("p9", None)]
    names = sorted({t for t, _ in tracks})
    plays = [(f"u{u}", t, k) for u, heard in enumerate((names[:100], names[40:41], rng.sample(names, 90), ["p5000"], ["p9"])) for k, t in enumerate(heard)]
    t = spark.createDataFrame(tracks, "track_id string, file_path string")
    i = spark.createDataFrame(plays, "user_id string, track_id string, last_played_at long")
    folders = {}
    for track, path in tracks:
        folders.setdefault(track, set()).add(path.rsplit("/", 1)[0] if path else None)
    want = set()
    for user in {u for u, _, _ in plays}:
        own = [(-at, track, d) for u, track, at in plays if u == user for d in folders[track] - {None}]
        dirs = {d for _, _, d in sorted(own)[:20]}
        heard = {track for u, track, _ in plays if u == user}
        want |= {(user, track) for track in sorted(n for n in names if folders[n] & dirs and n not in heard)[:50]}
    got = [(r.user_id, r.track_id) for r in recommend.same_folder(i, t, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sources_are_made_once(spark, monkeypatch):
    made, build = [], ivf.build
    monkeypatch.setattr(ivf, "build", lambda *a, **k: made.append(1) or build(*a, **k))
    recommend.united(*(g(spark, SF) for g in (c.interactions, c.track_features, c.similar_edges, c.track_vectors)))
    assert len(made) == 1


@pytest.mark.parametrize("most", [recommend.SENT_IDS, 0])
def test_only_plays_of_embedded_tracks_meet_the_vectors(spark, most):
    i = spark.createDataFrame([("u1", "p1", 0.5), ("u1", "p2", 0.9), ("u2", "p3", 0.1)], "user_id string, track_id string, satisfaction double")
    v = spark.createDataFrame([("p1", [3.0, 0.0]), ("p3", [0.0, 2.0])], "track_id string, v array<double>")
    kept = recommend.embedded(i, v, most)
    assert sorted((r.user_id, r.track_id) for r in kept.collect()) == [("u1", "p1"), ("u2", "p3")]
    assert {r.user_id: r.t for r in recommend.taste(i, v).collect()} == {"u1": [1.0, 0.0], "u2": [0.0, 1.0]}


def test_weak_sources_are_asked_for_open_users_only(spark):
    """Users with too few strong candidates over the bound get weak ones; the result is that of all sources at once."""
    rng, row = random.Random(9), "user_id string, track_id string, score double"
    strong = {s: spark.createDataFrame([(f"u{u}", f"t{k}", rng.choice([0.1, 0.3, 0.3 / 0.7, 0.5, 0.9])) for u in range(12) for k in rng.sample(range(30), 2 * u + 1)], row) for s in ("content", "external")}
    weak = {s: spark.createDataFrame([(f"u{u}", f"t{k}", 1.0) for u in range(13) for k in rng.sample(range(40), 8)], row) for s in ("artist", "popular")}
    out = spark.createDataFrame([(f"u{u}", f"t{rng.randrange(40)}") for u in range(12) for _ in range(4)], "user_id string, track_id string")
    users, asked = spark.createDataFrame([(f"u{u}",) for u in range(13)], "user_id string"), []

    def of(open_):
        asked.extend(r.user_id for r in open_.collect())
        return {s: d.join(open_, "user_id", "left_semi") for s, d in weak.items()}

    names = ("user_id", "track_id", "source", "priority", "score", "place")
    rows = lambda d: sorted(tuple(r[c] for c in names) for r in d.collect())
    got = rows(recommending.merge_in_turn(strong, of, 0.3, users, out, 10))
    assert got == rows(recommending.merge({**strong, **weak}, out, 10)) and 2 < len(set(asked)) < 13


def test_lists_of_users_are_dealt_once(spark):
    """What an outside service relates, and the presets of the dial, are shuffled by user before they are multiplied."""
    import __spark_entry__

    for name in ("D09_external_candidates", "E09_preset_report"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(user_id#\d+, track_id|hashpartitioning\(dial#\d+, user_id", plan)


def test_best_of_lists_over_batches():
    """A user's lists may go on in the next batch; each track counts with its best score, nulls come last."""
    rng = random.Random(5)
    lists = [(f"u{u}", [(f"t{rng.randrange(20)}", rng.choice([None, 0.1, 0.5, 0.9])) for _ in range(rng.randrange(8))]) for u in range(6) for _ in range(rng.randrange(1, 9))]
    want = {}
    for user, own in lists:
        for track, score in own:
            want.setdefault(user, {}).setdefault(track, []).append(-1.0 if score is None else score)
    want = {(u, t) for u, own in want.items() for _, t in sorted((-max(s), t) for t, s in own.items())[:7]}
    schema = pa.schema([("user_id", pa.string()), ("track_id", pa.list_(pa.string())), ("score", pa.list_(pa.float64())), ("place", pa.list_(pa.float64()))])
    columns = lambda rows: [[u for u, _ in rows], [[t for t, _ in o] for _, o in rows], *[[[s for _, s in o] for _, o in rows]] * 2]
    for size in (1, 4, 100):
        batches = (pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns(lists[n : n + size]), schema, strict=True)], schema=schema) for n in range(0, len(lists), size))
        got = [(r["user_id"], r["track_id"]) for b in ranking.best_of_lists(batches, 7) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_of_settled_users_only_their_list_is_written(spark, monkeypatch):
    """Candidates beyond the list are kept for users alone who may still get weak ones."""
    kept, stored = {}, recommending.shared.stored
    monkeypatch.setattr(recommending.shared, "stored", lambda df, name, *by: kept.setdefault(name, stored(df, name, *by)))
    strong = {"content": spark.createDataFrame([(u, f"t{k}", s) for u, s in (("u1", 0.9), ("u2", 0.2)) for k in range(30)], "user_id string, track_id string, score double")}
    weak = spark.createDataFrame([("u2", "t1", 1.0)], "user_id string, track_id string, score double")
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    made = recommending.merge_in_turn(strong, lambda open_: {"popular": weak}, 0.3, users, users.selectExpr("user_id", "'t99' AS track_id"), 10)
    assert made.count() == 20
    assert {r.user_id: r["count"] for r in kept["strong-candidates"].groupBy("user_id").count().collect()} == {"u1": 10, "u2": 30}


def test_vectors_stay_where_they_are(spark, monkeypatch):
    """What a history says of candidates is the same where all vectors are sent to the tasks; then only ids are shuffled."""
    i, v = c.interactions(spark, SF).cache(), c.track_vectors(spark, SF).cache()
    asked = recommend.content(i, v).select("user_id", "track_id", F.lit(0.5).alias("base")).cache()
    rows = lambda df: sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    near, sure = recommend.evidence(i, v), recommend.sure(asked, i, v)
    got = rows(near), rows(sure)
    assert "CoGroup" not in plan(sure) and not any("#" in x and " b#" in x for x in plan(near).splitlines())
    monkeypatch.setattr(recommend.vectors, "held", lambda *_: None)
    assert "CoGroup" in plan(recommend.sure(asked, i, v)) and (rows(recommend.evidence(i, v)), rows(recommend.sure(asked, i, v))) == got


def test_held_vectors_are_all_alike(spark):
    from cadenza.operators import vectors

    fine = [("a", [3.0, 4.0]), ("b", [0.0, 2.0])]
    of = lambda more, most=1000: vectors.held(spark.createDataFrame([*fine, *more], "track_id string, v array<double>"), "v", most)
    ids, x = of([])
    assert sorted(zip(ids, x.tolist(), strict=True)) == [("a", [0.6, 0.8]), ("b", [0.0, 1.0])]
    for odd in (("a", [1.0, 1.0]), (None, [1.0, 1.0]), ("c", None), ("c", [1.0]), ("c", [None, 1.0]), ("c", [0.0, 0.0]), ("c", [float("nan"), 1.0])):
        assert of([odd]) is None
    assert of([], 31) is None


def test_candidates_are_dealt_once(spark):
    """One shuffle serves bans, first sources and places; a ban without a user or track bans nothing."""
    rows = spark.createDataFrame([("u1", "a", 0.5), ("u1", "b", 0.4), ("u2", "a", 0.3), (None, "a", 0.2)], "user_id string, track_id string, score double")
    out = spark.createDataFrame([("u1", "a"), ("u1", "a"), ("u3", "a"), (None, "a"), ("u2", None)], "user_id string, track_id string")
    made = recommending.merge({"content": rows, "external": rows.withColumn("score", F.lit(2.0))}, out, 5)
    assert sorted(((r.user_id, r.track_id, r.source, r.score, r.place) for r in made.collect()), key=str) == sorted([("u1", "b", "content", 0.4, 1), ("u2", "a", "content", 0.3, 1), (None, "a", "content", 0.2, 1)], key=str)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_lists_are_shuffled_without_places(spark):
    """What an edge's score is rounded to is made after the shuffle by user."""
    i, x = c.interactions(spark, SF), c.similar_edges(spark, SF)
    plan = recommend.related(i, x)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "RepartitionByExpression [user_id" in line)
    assert any("place" in line for line in plan[:at]) and not any("place" in line for line in plan[at:])
