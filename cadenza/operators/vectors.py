"""Vectors of tracks: means, similarity to one and nearest ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import dot, unit


def mean(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """keys, v: the mean of each group's vectors, at length 1; partial sums by place."""
    long = df.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.avg("x").alias("m"))
    ordered = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("p"))
    return ordered.select(*keys, unit(F.col("p.m")).alias("v"))


def mean_of_few(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """mean of groups that are known to be small: their vectors are one row each, not one for each place."""
    some = df.groupBy(*keys).agg(F.collect_list(F.col(vector)).alias("p")).withColumn("n", F.size("p")).filter("n > 0")
    total = F.aggregate(F.slice("p", 2, F.greatest(F.col("n") - 1, F.lit(0))), F.col("p")[0], lambda a, x: F.zip_with(a, x, lambda y, z: y + z))
    return some.select(*keys, F.transform(total, lambda x: x / F.col("n")).alias("v")).select(*keys, unit(F.col("v")).alias("v"))


#: Bytes of vectors that are sent to every task at most.
SENT_BYTES = 32 << 20


def held(v: DataFrame, vector: str = "v", most: int = SENT_BYTES) -> tuple[list[str], np.ndarray] | None:
    """Ids and vectors of v at length 1, to be sent to every task; None where they are too many, some id repeats, or some is not a vector like the others."""
    n, dim = v.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not n or (dim or 0) < 1 or n * dim * 8 > most:
        return None
    t = v.select("track_id", F.col(vector).cast("array<double>").alias("v")).toArrow()
    ids, x = t.column("track_id").to_pylist(), t.column("v").combine_chunks()
    if None in ids or len(set(ids)) < len(ids) or x.null_count or (np.diff(np.asarray(x.offsets)) != dim).any() or x.flatten().null_count:
        return None
    x = np.asarray(x.flatten()).reshape(-1, dim)
    size = np.sqrt((x * x).sum(1))
    return (ids, x / size[:, None]) if np.isfinite(size).all() and (size > 1e-9).all() else None


def by_user(asked: DataFrame, pool: DataFrame, whole: tuple[list[str], np.ndarray], lend: Callable, schema: str) -> DataFrame:
    """What lend makes of a user's candidates (user_id, track_id) and pool (user_id, other, m), both of tracks in whole; only ids are shuffled.

    lend: of inner products (candidates by pool), m, and where a candidate is the same track, columns by candidate and which of them are kept.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    left = asked.groupBy("user_id").agg(F.collect_list("track_id").alias("ids"))
    right = pool.groupBy("user_id").agg(F.collect_list(F.struct("other", "m")).alias("own"))
    sent = asked.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        at = {name: k for k, name in enumerate(ids)}
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                of, tracks, made = [], [], []
                for k, (asked_ids, own) in enumerate(zip(part.column("ids").to_pylist(), part.column("own").to_pylist(), strict=True)):
                    rows, others = (np.array([at[n] for n in x_]) for x_ in (asked_ids, [o["other"] for o in own]))
                    m = np.array([o["m"] for o in own], float)
                    columns, kept = lend(x[rows] @ x[others].T, m, rows[:, None] == others)
                    of.append(np.full(int(kept.sum()), k))
                    tracks += [n for n, y in zip(asked_ids, kept.tolist(), strict=True) if y]
                    made.append(np.stack(columns)[:, kept])
                values = np.concatenate(made, axis=1) if made else np.zeros((len(names) - 2, 0))
                users = part.column("user_id").take(pa.array(np.concatenate([np.zeros(0, np.int64), *of]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([users, pa.array(tracks, pa.string()), *map(pa.array, values)], names)

    return left.join(right, "user_id").select("user_id", "ids", "own").mapInArrow(run, schema)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def nearest(vectors: DataFrame, target: DataFrame, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """track_id, score: the k vectors most like the one row of target (q), without those of exclude."""
    scored = vectors.join(F.broadcast(target.select(F.col("v").alias("q")))).select("track_id", cosine(F.col("v"), F.col("q")).alias("score"))
    if exclude is not None:
        scored = scored.join(exclude.select("track_id").distinct(), "track_id", "left_anti")
    return scored.orderBy(F.desc(F.round("score", 9)), "track_id").limit(k)


#: Vectors and queries of one block, and rows of one matrix product; what scores are rounded by later on.
SHARD, CHUNK, ROWS, SLACK = 32_768, 4096, 256, 2e-8


def best_of_all(asked: DataFrame, units: DataFrame, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """user_id, track_id, s: for each of asked (user_id, d, k) its k tracks of units (track_id, u) of largest inner product, and those within SLACK of the last; exact.

    Every block of queries meets every block of vectors in a task of its own; a user's answers of several blocks are not merged.
    """
    parts, chunks = (max(1, -(-df.count() // n)) for df, n in ((units, shard), (asked, chunk)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(part("user_id", chunks).alias("c"), every(parts).alias("g"), "user_id", "d", F.col("k").cast("long").alias("k"))
    right = units.select(part("track_id", parts).alias("g"), every(chunks).alias("c"), "track_id", "u")
    return left.groupBy("c", "g").cogroup(right.groupBy("c", "g")).applyInArrow(_best_of_block, "user_id string, track_id string, s double")


def _best_of_block(asked: pa.Table, units: pa.Table) -> pa.Table:
    empty = pa.table({"user_id": pa.array([], pa.string()), "track_id": pa.array([], pa.string()), "s": pa.array([], pa.float64())})
    if not len(asked) or not len(units):
        return empty
    matrix = lambda t, c: np.asarray(t.column(c).combine_chunks().flatten()).reshape(len(t), -1)
    d, u, k = matrix(asked, "d"), matrix(units, "u"), np.minimum(np.asarray(asked.column("k")), len(units))
    found = []
    for a in range(0, len(d), ROWS):
        score = d[a : a + ROWS] @ u.T
        for at, own in enumerate(score, a):
            near = np.flatnonzero(own >= np.partition(own, len(own) - k[at])[len(own) - k[at]] - SLACK)
            found.append((np.full(len(near), at), near, own[near]))
    who, what, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"user_id": asked.column("user_id").take(pa.array(who)), "track_id": units.column("track_id").take(pa.array(what)), "s": pa.array(s)})


#: Items and users of one block of best_others.
ITEMS, USERS = 1 << 18, 1 << 17


def best_others(asked: DataFrame, items: DataFrame, k: int, shard: int = ITEMS, chunk: int = USERS) -> DataFrame:
    """user, item, score: for each of asked (user, d, played) its k items (item, u) of largest inner product that are not in played; exact, equal ones by item.

    Every block of users meets every block of items in a task of its own, which gives k items a user at most.
    """
    parts, chunks = (max(1, -(-df.count() // n)) for df, n in ((items, shard), (asked, chunk)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(part("user", chunks).alias("c"), every(parts).alias("g"), "user", "d", "played")
    right = items.select(part("item", parts).alias("g"), every(chunks).alias("c"), "item", "u")
    found = left.groupBy("c", "g").cogroup(right.groupBy("c", "g")).applyInArrow(lambda x, y: _best_others(x, y, k), "user int, item int, score double")
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def _best_others(asked: pa.Table, items: pa.Table, k: int) -> pa.Table:
    matrix = lambda t, c: np.asarray(t.column(c).combine_chunks().flatten()).reshape(len(t), -1)
    found: list[tuple] = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
    if len(asked) and len(items):
        by = np.argsort(item := np.asarray(items.column("item")), kind="stable")
        item, u, d, user = item[by], matrix(items, "u")[by], matrix(asked, "d"), np.asarray(asked.column("user"))
        heard = asked.column("played").combine_chunks()
        ends, heard = np.asarray(heard.offsets), np.asarray(heard.values)
        for a in range(0, len(d), 64):
            score = d[a : a + 64] @ u.T
            for n, own in enumerate(score, a):
                played = heard[ends[n] : ends[n + 1]]
                at = np.minimum(np.searchsorted(item, played), len(item) - 1)
                own[at[item[at] == played]] = -np.inf
                best = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
                best = best[own[best] > -np.inf]
                best = best[np.argsort(-own[best], kind="stable")][:k]
                found.append((np.full(len(best), user[n], np.int32), item[best], own[best].astype(float)))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["user", "item", "score"])


def centred(vectors: DataFrame) -> DataFrame:
    """track_id, v without the mean of all, at length 1."""
    places = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"))
    centre = places.agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("p")).select(F.col("p.m").alias("c"))
    return vectors.join(F.broadcast(centre)).select("track_id", unit(F.zip_with("v", "c", lambda x, y: x - y)).alias("v"))


def between(a: Column, b: Column, t: float) -> Column:
    """The point at t on the arc from a to b, both of length 1."""
    angle = F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0)))
    flat = F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)
    return F.when(F.sin(angle) < 1e-6, flat).otherwise(F.zip_with(a, b, lambda x, y: (F.sin((1 - t) * angle) * x + F.sin(t * angle) * y) / F.sin(angle)))
