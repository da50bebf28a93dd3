"""Hard negatives by a cover tree over norm-augmented vectors.

A component more, sqrt(M^2 - |x|^2) with M the greatest length, puts all
candidates at the same distance from the origin; from a query with nothing there,
|q - x|^2 = M^2 + |q|^2 - 2 q.x, so that inner products are distances and a ball
of candidates bounds them from both sides.

Vectors of a label that are equal are one candidate with its smallest ids, as many
as can ever be among the first. Candidates are dealt to cells: centres are chosen
far apart from a bounded sample, each candidate goes to the nearest one, and a
large cell is split by hash into shards of about SHARD_ROWS. Labels are kept apart
by groups of labels, so that a search for the same label meets its group alone. In
each shard a tree is built: the children of a node are as far from each other as
half its covering radius, and each covers what lies within that of it, so radii
halve from level to level. Trees are written once, breadth first, and searched by
both rounds.

A query goes to the cells whose ball meets its window of inner products and
exceeds what the sample alone already gives it, and walks their trees from the
node with the highest bound on. Nodes outside of all its windows, or under the k
best found in each, are skipped; members of all others are scored exactly, as whole
numbers. The first round finds positives, the second what lies in the window that
each positive sets.

Defined cases: rows whose id, label or vector is null, that hold a null or
non-finite component, are empty, or are of another length than most, take no part;
nor do those of a scaled length of 2**31 or more, as their scores would not fit in
a long. Rows that repeat (id, label and vector) count once; an id never is its own
positive or negative; equal scores go to the smaller id; a positive whose score is
negative has no window; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions, picked, split_join, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Candidates of a shard, about.
SHARD_ROWS = 2048
#: Most candidates that centres and first bounds are taken from, and most centres.
SAMPLE, CELLS = 8192, 256
#: Groups of labels.
GROUPS = 16
#: Members of a node that become leaves without levels of their own.
LEAF = 16
_SALTS = 1024
#: The window of a positive's score s: 30 s <= 100 score <= 90 s, in whole numbers that do not overflow.
LOW = "transform(scores, s -> 3 * (s div 10) + (3 * (s % 10) + 9) div 10)"
HIGH = "transform(scores, s -> 9 * (s div 10) + (9 * (s % 10)) div 10)"
LEAST, MOST = -(2**63), 2**63 - 1
#: Added to bounds, against rounding, as a share of the squared lengths.
_SLACK = 1e-9


def anchors_of(vec_id: Column) -> Column:
    return vec_id % 100 == 0


def relabelled(vec_id: Column, label: Column) -> Column:
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def candidates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (scaled to whole numbers) of the rows that take part."""
    x = picked(vectors, id_col, vec_col, label_col).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**31 / SCALE)) & (F.size("x") > 0)
    scaled = x.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine).select("id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return scaled.filter(length < 2.0**62).withColumn("label", relabelled(F.col("id"), F.col("label")))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """label, v, ids: the keep smallest ids of each label's equal vectors."""
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    first = rows.groupBy("label", "v", salt.alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"))
    return first.groupBy("label", "v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.int64)


class Rows:
    """Rows of whole numbers, for exact inner products: in floating point where every sum is a whole number below 2**53."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.f = x, x.astype(float)
        self.length = math.sqrt(float((self.f * self.f).sum(1).max())) if len(x) else 0.0

    def products(self, q: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        f = q.astype(float)
        if self.length * math.sqrt(float(f @ f)) < 2**52:
            return (self.f[a:b] @ f).astype(np.int64)
        return self.x[a:b] @ q


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """x with the component that brings its squared length to most."""
    y = x.astype(float)
    return np.concatenate([y, np.sqrt(np.maximum(most - (y * y).sum(1), 0))[:, None]], axis=1)


def _distances(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((y - c) ** 2).sum(1))


def far_apart(y: np.ndarray, k: int) -> np.ndarray:
    """Places of k rows (fewer if all others are copies), each the farthest from those before."""
    chosen, nearest = [0], _distances(y, y[0])
    while len(chosen) < k and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(y, y[chosen[-1]]))
    return np.array(chosen)


@dataclass
class Tree:
    """A cover tree, breadth first: place of each node's row, its covering radius, its children first..first+count."""

    order: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    count: np.ndarray


def cover_tree(y: np.ndarray, leaf: int = LEAF) -> Tree:
    """Children of a node cover its members within half its radius; a node of few or equal members has them as leaves."""
    order, radius, first, count = [0], [], [], []
    members = [np.arange(1, len(y))]
    at = 0
    while at < len(order):
        own = members[at]
        away = _distances(y[own], y[order[at]]) if len(own) else np.zeros(0)
        r = float(away.max()) if len(own) else 0.0
        radius.append(r)
        first.append(len(order))
        if len(own) <= leaf or r == 0:
            order.extend(own.tolist())
            members.extend([own[:0]] * len(own))
        else:
            z, left = y[own], np.arange(len(own))
            squares = (z * z).sum(1)
            while len(left):
                c = left[0]
                near = squares[left] + squares[c] - 2 * (z[left] @ z[c]) <= r * r / 4
                near[0] = True
                order.append(int(own[c]))
                members.append(own[left[near][1:]])
                left = left[~near]
        count.append(len(order) - first[-1])
        members[at] = own[:0]
        at += 1
    return Tree(np.array(order), np.array(radius), np.array(first), np.array(count))


class Bounds:
    """From distances to a centre and its radius to bounds of inner products."""

    def __init__(self, most: float, q: np.ndarray) -> None:
        self.whole = most + float((q.astype(float) ** 2).sum())
        self.slack = _SLACK * self.whole + 1

    def of(self, score: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product within radius of a centre of that score."""
        d = np.sqrt(np.maximum(self.whole - 2 * score.astype(float), 0))
        r = radius * (1 + _SLACK)
        return (self.whole - (d + r) ** 2) / 2 - self.slack, (self.whole - np.maximum(d - r, 0) ** 2) / 2 + self.slack


class Windows:
    """Windows low..high of scores, each with the k best found in it."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in low]
        self.least = self.low.copy()

    def wanted(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Which nodes may hold one that is in a window and no worse than its k-th best."""
        return ((upper[:, None] >= self.least) & (lower[:, None] <= self.high)).any(1)

    def offer(self, score: np.ndarray, at: np.ndarray) -> None:
        """Rows at of these scores; ties are all kept, to be told apart by their ids."""
        for w in range(len(self.low)):
            new = (score >= self.least[w]) & (score <= self.high[w])
            if new.any():
                best = self.best[w]
                best.extend(zip(score[new].tolist(), at[new].tolist(), strict=True))
                if len(best) > self.k:
                    kth = heapq.nlargest(self.k, (s for s, _ in best))[-1]
                    self.best[w] = [x for x in best if x[0] >= kth]
                    self.least[w] = max(self.least[w], kth)
                elif len(best) == self.k:
                    self.least[w] = max(self.least[w], min(s for s, _ in best))


def descend(tree: Tree, x: Rows, fits: np.ndarray, q: np.ndarray, most: float, windows: Windows) -> int:
    """Fills windows with the best of x (rows by tree order) that fit; returns how many rows were scored."""
    bounds, scored = Bounds(most, q), 1
    root = x.products(q, 0, 1)
    if fits[0]:
        windows.offer(root, np.zeros(1, np.int64))
    heap = [(-float(bounds.of(root, tree.radius[:1])[1][0]), float(bounds.of(root, tree.radius[:1])[0][0]), 0)]
    while heap:
        upper, lower, node = heapq.heappop(heap)
        if not tree.count[node] or not windows.wanted(np.array([lower]), np.array([-upper]))[0]:
            continue
        a, b = int(tree.first[node]), int(tree.first[node] + tree.count[node])
        score = x.products(q, a, b)
        scored += b - a
        inside = fits[a:b]
        windows.offer(score[inside], np.flatnonzero(inside) + a)
        parents = np.flatnonzero(tree.count[a:b])
        if len(parents):
            lows, highs = bounds.of(score[parents], tree.radius[a:b][parents])
            for k in np.flatnonzero(windows.wanted(lows, highs)).tolist():
                heapq.heappush(heap, (-float(highs[k]), float(lows[k]), a + int(parents[k])))
    return scored


@dataclass
class Index:
    """shards: the written trees; cells: (group, cell) with centre, radius and shards; sample: label and v of the sampled candidates."""

    dim: int
    most: float
    shards: DataFrame | None
    cells: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    n_shards: np.ndarray
    sample_labels: np.ndarray
    sample: np.ndarray


def _group(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(GROUPS)).cast("int")


def build_index(rows: DataFrame, dim: int, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE) -> Index:
    """rows: id, label, v of one length."""
    spark = rows.sparkSession
    classes = written(_classes(rows, max(POSITIVES, NEGATIVES) + 1), "negatives-classes")
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, most = classes.agg(F.count(F.lit(1)), F.max(length)).first()
    some = classes.orderBy(F.xxhash64("label", "v"), "label", "v").limit(sample_rows).select("label", "v").toPandas()
    sample = np.array(some["v"].tolist(), np.int64).reshape(-1, dim)
    own = augmented(sample, most)
    centres = own[far_apart(own, max(1, min(CELLS, n // (4 * shard_rows))))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centres * centres).sum(1)
        for b in batches:
            y = augmented(_matrix(b.column(2), dim), most)
            cell = (squares - 2 * (y @ centres.T)).argmin(1)
            away = np.sqrt(((y - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["grp", "label", "v", "ids", "cell", "away"])

    cells = written(classes.select(_group(F.col("label")).alias("grp"), "label", "v", "ids").mapInArrow(assign, "grp int, label long, v array<long>, ids array<long>, cell int, away double"), "negatives-cells")
    sizes = sorted(map(tuple, cells.groupBy("grp", "cell").agg(F.count(F.lit(1)), F.max("away")).collect()))  # at most GROUPS * CELLS
    keys = np.array([s[:2] for s in sizes], np.int64).reshape(-1, 2)
    n_shards = np.array([max(1, -(-s[2] // shard_rows)) for s in sizes], np.int64)
    starts = [int(n_shards[:k].sum()) for k in range(len(sizes))]
    numbers = spark.createDataFrame([(int(k[0]), int(k[1]), a, n) for k, a, n in zip(keys, starts, n_shards.tolist(), strict=True)], "grp int, cell int, start long, parts long")
    shard = F.col("start") + F.pmod(F.xxhash64("label", "v", F.lit(3)), F.col("parts"))
    dealt = cells.join(F.broadcast(numbers), ["grp", "cell"]).select(shard.alias("shard"), "label", "v", "ids").repartition(partitions(spark), "shard").sortWithinPartitions("shard")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _runs(batches):
            table = pa.Table.from_batches(rows).combine_chunks()
            tree = cover_tree(augmented(_matrix(table.column(2).combine_chunks(), dim), most))
            table = table.take(pa.array(tree.order))
            yield from pa.table({"shard": table.column(0), "at": pa.array(np.arange(len(table))), "label": table.column(1), "v": table.column(2), "ids": table.column(3), "radius": pa.array(tree.radius), "first": pa.array(tree.first), "n_children": pa.array(tree.count)}).combine_chunks().to_batches()

    shards = written(dealt.mapInArrow(grow, "shard long, at long, label long, v array<long>, ids array<long>, radius double, first long, n_children long"), "negatives-trees")
    return Index(dim, most, shards, keys, centres[keys[:, 1]] if len(keys) else centres[:0], np.array([s[3] for s in sizes]), n_shards, some["label"].to_numpy(np.int64), sample)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches cut and gathered by their first column, by which they are sorted; a shard is bounded."""
    now, held = None, []
    for b in batches:
        key = np.asarray(b.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if held and int(key[a]) != now:
                yield now, held
                held = []
            now = int(key[a])
            held.append(b.slice(a, z - a))
    if held:
        yield now, held


def _routed(index: Index, same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends queries (asker, label, group, v, low, high) to the shards that may hold what they want, with the bounds known from the sample."""
    starts = np.concatenate([[0], np.cumsum(index.n_shards)])
    rows = index.sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Rows(rows)
        for b in batches:
            shard, take, least = [], [], []
            v = _matrix(b.column(3), index.dim)
            for i, (label, group, low, high) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 4, 5)), strict=True)):
                q = v[i]
                windows = Windows(np.array(low), np.array(high), k)
                fits = np.flatnonzero((index.sample_labels == label) == same)
                windows.offer(sample.products(q)[fits], fits)
                bounds = Bounds(index.most, q)
                away = np.sqrt(((index.centres[:, :-1] - q) ** 2).sum(1) + index.centres[:, -1] ** 2)
                lower, upper = bounds.of((bounds.whole - away**2) / 2, index.radius)
                met = windows.wanted(lower, upper)
                if same:
                    met &= index.cells[:, 0] == group
                for c in np.flatnonzero(met).tolist():
                    shard.extend(range(starts[c], starts[c + 1]))
                    take.extend([i] * int(index.n_shards[c]))
                    least.extend([windows.least.tolist()] * int(index.n_shards[c]))
            for a in range(0, len(take), 4096):
                part = pa.array(take[a : a + 4096], pa.int64())
                taken = [c.take(part) for c in b.columns]
                yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + 4096], pa.int64()), taken[0], taken[1], taken[3], taken[4], taken[5], pa.array(least[a : a + 4096], pa.list_(pa.int64()))], ["shard", "asker", "label", "v", "low", "high", "least"])

    return run


def search(index: Index, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """asker, window, score, ids: the k best candidates, of the same label or of others, in each window of each query.

    queries: asker (string), label, v, low and high (arrays of longs). More than k where scores tie.
    """
    spark, dim, most = queries.sparkSession, index.dim, index.most
    sent = queries.select("asker", "label", _group(F.col("label")).alias("grp"), "v", "low", "high").mapInArrow(_routed(replace(index, shards=None), same, k), "shard long, asker string, label long, v array<long>, low array<long>, high array<long>, least array<long>")
    none = lambda kind: F.lit(None).cast(kind)
    stored = index.shards.select("shard", F.lit(False).alias("asks"), "at", "label", "v", "ids", "radius", "first", "n_children", none("array<long>").alias("low"), none("array<long>").alias("high"), none("array<long>").alias("least"), none("string").alias("asker"))
    asked = sent.select("shard", F.lit(True).alias("asks"), none("long").alias("at"), "label", "v", none("array<long>").alias("ids"), none("double").alias("radius"), none("long").alias("first"), none("long").alias("n_children"), "low", "high", "least", "asker")
    dealt = stored.unionByName(asked).repartition(partitions(spark), "shard").sortWithinPartitions("shard", "asks", "at")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            table = pa.Table.from_batches(rows).combine_chunks()
            asks = np.asarray(table.column(1).combine_chunks().cast(pa.int8())).astype(bool)
            own, asked = table.slice(0, int((~asks).sum())), table.slice(int((~asks).sum()))
            tree = Tree(np.zeros(0), *(np.asarray(own.column(c).combine_chunks()) for c in (6, 7, 8)))
            x, labels, ids = Rows(_matrix(own.column(4).combine_chunks(), dim)), np.asarray(own.column(3).combine_chunks()), own.column(5).combine_chunks()
            for b in asked.to_batches(512):
                out: list[tuple[str, int, int, int]] = []
                qs = _matrix(b.column(4), dim)
                for i, (asker, label, low, high, least) in enumerate(zip(*(b.column(c).to_pylist() for c in (12, 3, 9, 10, 11)), strict=True)):
                    windows = Windows(np.array(low), np.array(high), k)
                    windows.least = np.array(least)
                    descend(tree, x, (labels == label) == same, qs[i], most, windows)
                    out.extend((asker, w, s, at) for w, best in enumerate(windows.best) for s, at in best)
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), ids.take(pa.array(cols[3], pa.int64()))], ["asker", "window", "score", "ids"])

    return dealt.mapInArrow(answer, "asker string, window int, score long, ids array<long>")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first ids of each key, higher scores before, then smaller ids."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base = candidates(vectors, id_col, vec_col, label_col)
    dims = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    rows = base.filter(F.size("v") == dims[0].d)
    index = build_index(rows, dims[0].d, shard_rows, sample_rows)
    key = F.concat_ws(":", F.xxhash64("label", "v"), F.xxhash64(F.lit(7), "label", "v"))
    anchors = written(rows.filter(anchors_of(F.col("id"))).distinct().withColumn("asker", key), "negatives-anchors")
    asking = anchors.groupBy("asker").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    asking = written(asking, "negatives-askers")
    everything = asking.select("asker", "label", "v", F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high"))
    near = search(index, everything, True, POSITIVES + 1).select("asker", "score", F.explode("ids").alias("id"))
    near = _first(near, ["asker"], POSITIVES + 1).groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    near = written(near.withColumn("scores", F.array_sort(F.array_distinct(F.filter("near.score", lambda s: s >= 0)))), "negatives-positives")
    windows = asking.join(near.filter(F.size("scores") > 0), "asker").select("asker", "label", "v", F.expr(LOW).alias("low"), F.expr(HIGH).alias("high"))
    found = search(index, windows, False, NEGATIVES).select("asker", "window", "score", F.explode("ids").alias("id"))
    best = _first(found, ["asker", "window"], NEGATIVES).groupBy("asker").agg(F.collect_list(F.struct("window", "rank", "id", "score")).alias("best"))
    answers = asking.select("asker", "n").join(near, "asker").join(best, "asker")
    total = asking.agg(F.sum("n")).first()[0] or 0
    own = split_join(anchors.select("asker", F.col("id").alias("anchor_id")), answers, "asker", total)
    own = own.select("anchor_id", "scores", "best", F.explode(F.slice(F.filter("near", lambda x: x.id != F.col("anchor_id")), 1, POSITIVES)).alias("p"))
    pairs = own.select("anchor_id", "p", F.explode(F.filter("best", lambda x: F.get("scores", x.window) == F.col("p.score"))).alias("x"))
    return pairs.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("x.rank").cast("int").alias("rank"), F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"))
