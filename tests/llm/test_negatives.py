"""Hard negatives against all pairs, the tree's invariants, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import negatives
from tests.llm import brute

KIND = "vec_id long, embedding array<double>, label int"


def vectors(n: int, dim: int = 8, seed: int = 1, hot: bool = False) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, dim))
    if hot:
        x[::3] = x[0]  # a third of all are copies, under several labels
    return [(k, x[k].tolist(), int(rng.integers(0, 4))) for k in range(n)]


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("hot", [False, True])
def test_equals_all_pairs(spark, hot):
    own = vectors(1500, hot=hot)
    made = negatives.mine(spark.createDataFrame(own, KIND).repartition(5), shard_rows=64, sample_rows=100)
    assert got(made) == brute.hard_negatives(own)


def test_odd_rows(spark):
    """What takes no part, an id with two vectors, lengths beyond exact doubles, ties, clashing columns; nothing at all."""
    big = [2.0**22 + 0.3, 2.0**21, 7.1, -3.0]
    own = [(k, [k % 3 / 2, 1.0, -0.5, k % 5 / 4], k % 3) for k in range(0, 900, 9)]
    own += [(100 * k + 1, [x / (k + 1) for x in big], k % 2) for k in range(12)] + [(1200, big, 1)]
    own += [(2, None, 1), (3, [None, 1.0, 1.0, 1.0], 1), (4, [float("nan"), 1.0, 1.0, 1.0], 0), (5, [float("inf"), 1.0, 1.0, 1.0], 0), (6, [1.0] * 4, None), (None, [1.0] * 4, 1), (8, [0.0] * 4, 1), (9, [0.0] * 4, 1), (9, [0.0] * 4, 1)]
    other = [(11, [1.0, 2.0], 1), (12, [], 1)]
    docs = spark.createDataFrame(own + other, KIND).select("*", *[F.lit(1).alias(c) for c in ("id", "v", "shard", "asker", "scores", "grp")])
    assert got(negatives.mine(docs, shard_rows=16, sample_rows=10)) == brute.hard_negatives(own)
    assert negatives.mine(docs.limit(0)).count() == 0


def test_tree_covers_and_separates():
    """Every node's descendants lie within its radius, children far apart where it has levels, and each row is one node."""
    y = negatives.augmented(np.random.default_rng(3).integers(-40, 40, (500, 4)), 1e4)
    tree = negatives.cover_tree(y)
    assert sorted(tree.order.tolist()) == list(range(500))

    def below(k: int) -> list[int]:
        own = range(tree.first[k], tree.first[k] + tree.count[k])
        return [k, *(d for c in own for d in below(c))]

    for k in range(500):
        away = np.linalg.norm(y[tree.order[below(k)]] - y[tree.order[k]], axis=1)
        assert away.max() <= tree.radius[k] + 1e-6
        inner = [c for c in range(tree.first[k], tree.first[k] + tree.count[k]) if tree.count[c]]
        for i, a in enumerate(inner):
            assert all(np.linalg.norm(y[tree.order[a]] - y[tree.order[b]]) > tree.radius[k] / 2 - 1e-6 for b in inner[:i])


def test_descent_skips_and_is_exact():
    """On clustered rows most are never scored, and what is found is the best of each window."""
    rng = np.random.default_rng(5)
    x = (rng.integers(-4000, 4000, (20, 6))[rng.integers(0, 20, 4000)] + rng.integers(-30, 30, (4000, 6))).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(1).max())
    tree = negatives.cover_tree(negatives.augmented(x, most))
    rows = negatives.Rows(x[tree.order])
    for q in x[:20]:
        s = rows.products(q)
        top = int(s.max())
        w = negatives.Windows(np.array([negatives.LEAST, top * 3 // 10]), np.array([negatives.MOST, top * 9 // 10]), 10)
        scored = negatives.descend(tree, rows, np.ones(4000, bool), q, most, w)
        assert scored < 2500
        for best, fits in zip(w.best, (s, s[(s >= top * 3 // 10) & (s <= top * 9 // 10)]), strict=True):
            assert sorted((v for v, _ in best), reverse=True)[:10] == np.sort(fits)[::-1][:10].tolist()
