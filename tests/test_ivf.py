"""The inverted file: exact below its bound, recall above it, and only probed cells read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import ivf


def library(spark, n=3000, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(f"p{k}", v.tolist()) for k, v in enumerate(x)], "track_id string, v array<double>")


def test_recall_and_probed_cells(spark):
    lib = library(spark).cache()
    exact = ivf.neighbours(lib, 10).cache()
    index = ivf.build(lib, flat_below=1000, shard_rows=50)
    assert len(index.centres) == 54 and index.probes == 13 and max(index.shards.values()) > 1
    found = ivf.search(index, lib.select(F.col("track_id").alias("query"), "v"), 10).cache()
    assert ivf.recall(found, exact) >= 0.9 and found.count() == 30_000
    one = ivf.search(index, lib.filter("track_id = 'p7'").select(F.col("track_id").alias("query"), "v"), 10)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") or "cell#" in plan.split("PartitionFilters: [")[1][:80]
    read = {r.cell for r in ivf.probed(index, lib.filter("track_id = 'p7'").select(F.col("track_id").alias("query"), "v")).collect()}
    assert len(read) == 13


def test_whole_index_is_exact(spark):
    """Vectors that point anywhere: probed cells miss some of the nearest, all cells none."""
    rng = np.random.default_rng(4)
    lib = spark.createDataFrame([(f"p{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 16)))], "track_id string, v array<double>").cache()
    asked = lib.limit(20).select(F.col("track_id").alias("query"), "v").cache()
    exact, index = ivf.build(lib), ivf.build(lib, flat_below=1000)
    rows = lambda i: sorted((r.query, r.rank, r.track_id) for r in ivf.search(i, asked, 10).collect())
    assert rows(ivf.whole(index)) == rows(exact) != rows(index)


@pytest.mark.parametrize("centred", [False, True])
def test_flat_is_exact(spark, centred):
    lib = library(spark, 200, 5)
    x = {r.track_id: np.array(r.v) / np.linalg.norm(r.v) for r in lib.collect()}
    if centred:
        mean = np.mean(list(x.values()), 0)
        x = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in x.items()}
    got = {(r.query, r.rank): (r.track_id, round(r.score, 6)) for r in ivf.neighbours(lib, 3, centred).collect()}
    for q, v in x.items():
        best = sorted(((-round(float(v @ w), 9), k) for k, w in x.items() if k != q))[:3]
        assert [got[q, n] for n in (1, 2, 3)] == [(k, round(-s, 6)) for s, k in best]


def test_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", []), ("f", [0.0, 0.0]), ("g", [None, 1.0]), ("h", [float("nan"), 1.0]), (None, [1.0, 1.0]), ("i", [1.0, 1.0, 1.0])]
    lib = spark.createDataFrame(rows, "track_id string, v array<double>")
    got = sorted((r.query, r.rank, r.track_id) for r in ivf.neighbours(lib, 5).collect())
    assert got == [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c"), ("c", 1, "a"), ("c", 2, "b")]
    assert ivf.neighbours(lib.limit(0)).count() == 0


@pytest.mark.parametrize("flat_below", [50_000, 1000])
def test_many_queries_of_a_cell_are_dealt(spark, monkeypatch, flat_below):
    """Queries of a cell are answered by several tasks, each of which reads all its shards."""
    lib = library(spark, 1500).cache()
    index = ivf.build(lib, flat_below=flat_below, shard_rows=400)
    asked = lib.select(F.col("track_id").alias("query"), "v")
    rows = lambda: sorted((r.query, r.rank, r.track_id, r.score) for r in ivf.search(index, asked, 5, 400).collect())
    one = rows()
    monkeypatch.setattr(ivf, "ASKED", 10)
    assert rows() == one and len(one) == 7500
    assert max(ivf.dealt(index, asked, 400)[1].values()) >= 15


def test_sample_leaves_what_it_cannot_hold(spark):
    """The sample is the first by hash, and each task takes part with few rows, however many tasks there are."""
    n, most = 20_000, 500
    units = spark.range(n, numPartitions=16).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("track_id"))
    made = ivf.sampled(units, n, most)
    want = [r.track_id for r in units.orderBy(F.xxhash64("track_id"), "track_id").limit(most).collect()]
    assert [r.track_id for r in made.collect()] == want
    assert "xxhash64(track_id" in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "Filter (xxhash64" in plan
    same = spark.range(n).select(F.lit("p1").alias("track_id"))
    assert ivf.sampled(same, n, most).count() == most


def test_sent_index_finds_the_same(spark):
    """Queries that meet the whole index where they are: the same answers without a shuffle, and none for odd vectors."""
    lib = library(spark, 700).cache()
    index = ivf.build(lib)
    odd = [("x1", None), ("x2", []), ("x3", [0.0] * 16), ("x4", [float("nan")] + [1.0] * 15), ("x5", [None] + [1.0] * 15), ("x6", [1.0] * 15), (None, [1.0] * 16), ("x7", [2.0] * 16)]
    asked = lib.select(F.col("track_id").alias("query"), "v").unionByName(spark.createDataFrame(odd, "query string, v array<double>"))
    found = ivf.sent(index, asked, 10)
    rows = lambda df: sorted((r.query, r.track_id, round(r.score, 8)) for r in df.collect())
    assert rows(found) == rows(ivf.search(index, asked, 10)) and found.count() == 7010
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert ivf.sendable(index) and not ivf.sendable(index, 1000) and not ivf.sendable(ivf.build(lib, flat_below=100))
