"""Nearest vectors by an inverted file: coarse cells, of which a query reads a few.

Vectors are brought to length 1, after their mean is taken off where asked, so that
inner products are cosines. Below FLAT_BELOW vectors there is one cell and the search
is exact. From there on there are min(sqrt(n), 256) cells around centres by k-means on
a bounded sample; every vector is stored in the folder of its cell, and a query
probes min(cells / 4, 16) of them. Large cells are read in shards of SHARD_ROWS, many
queries of a cell are dealt to several tasks, and they are scored against a shard in
blocks of one matrix product. An index of one cell and few bytes can be sent to where the
queries are instead, so that neither they nor their answers are shuffled.

Null, empty and zero vectors, and those with null or non-finite components, take no
part; nor do those of another length than most. Equal scores (to nine places) go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import unit
from ..sources.shared import path
from .vectors import SENT_BYTES

FLAT_BELOW = 50_000
CELLS, PROBES = 256, 16
#: Most vectors that centres are fitted on, and rounds of it.
SAMPLE, ROUNDS = 20_000, 12
SHARD_ROWS = 65_536
#: Queries of a cell that one task answers at least; beyond them, or a quarter of a shard's rows, they are dealt to tasks that each read the shard.
ASKED = 2048
BLOCK = 256


@dataclass
class Index:
    """table: track_id, u, salt, cell, stored by cell; centres of the cells; how many of them a query probes; shards and rows of each cell; the mean taken off (or none)."""

    table: DataFrame
    centres: np.ndarray
    probes: int
    shards: dict[int, int]
    rows: dict[int, int]
    mean: list[float] | None

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def valid(df: DataFrame, id_col: str = "track_id") -> DataFrame:
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: F.abs(x) > 1e-9)
    return df.select(id_col, F.col("v").cast("array<double>").alias("v")).filter(F.col(id_col).isNotNull() & F.col("v").isNotNull() & fine)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Centres of length 1 by cosine; an empty cell takes the row that is worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        score = x @ centres.T
        own, best = score.argmax(1), score.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        for c in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
            worst = int(best.argmin())
            sums[c], best[worst] = x[worst], 1.0
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def prepared(df: DataFrame, mean: list[float] | None, id_col: str = "track_id") -> DataFrame:
    """id, u: vectors at length 1, without the mean where there is one."""
    made = valid(df, id_col).select(id_col, unit(F.col("v")).alias("u"))
    if mean is None:
        return made
    off = F.zip_with("u", F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return made.select(id_col, off.alias("u")).filter(F.exists("u", lambda x: F.abs(x) > 1e-9)).select(id_col, unit(F.col("u")).alias("u"))


def sampled(units: DataFrame, n: int, most: int) -> DataFrame:
    """The `most` rows of smallest hash of n (track_id, u). What can't be among them is left where it is, as every task sends the driver all that it takes for the first."""
    key = F.xxhash64("track_id")
    share = 1.2 * most / n + 0.001
    if share < 1:
        few = units.filter(key < F.lit(int(share * 2.0**64) - 2**63))
        if few.count() >= most:
            units = few
    return units.orderBy(key, "track_id").limit(most)


def build(df: DataFrame, centred: bool = False, flat_below: int = FLAT_BELOW, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> Index | None:
    """The index of df (track_id, v), or None where no vector is valid."""
    good = valid(df)
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).collect()[:1]
    if not dims:
        return None
    dim, n = dims[0].d, dims[0]["count"]
    own = good.filter(F.size("v") == dim)
    mean = None
    if centred:
        mean = [r.m for r in own.select(F.posexplode(unit(F.col("v"))).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).orderBy("at").collect()]
    units = prepared(own, mean)
    cells = 1 if n < flat_below else max(1, min(int(n**0.5), CELLS))
    centres = np.zeros((1, dim))
    if cells > 1:
        some = sampled(units, n, sample).select("u").toPandas()
        centres = k_means(np.array(some["u"].tolist()), cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = (_matrix(b.column(1), dim) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["track_id", "u", "salt", "cell"])

    salted = units.select("track_id", "u", F.pmod(F.xxhash64("track_id"), F.lit(1 << 30)).alias("salt"))
    at = path(df.sparkSession, "inverted-file")
    made = salted.mapInArrow(assign, "track_id string, u array<double>, salt long, cell int")
    made.repartition(F.col("cell"), F.col("salt") % 8).write.partitionBy("cell").parquet(at)
    table = df.sparkSession.read.schema(made.schema).parquet(at)
    sizes = table.groupBy("cell").count().collect()  # a row for each cell
    return Index(table, centres, max(1, min(len(centres) // 4, PROBES)), {r.cell: max(1, -(-r["count"] // shard_rows)) for r in sizes}, {r.cell: r["count"] for r in sizes}, mean)


def whole(index: Index | None) -> Index | None:
    """index with every cell probed, so that few queries are answered exactly."""
    return index and replace(index, probes=len(index.centres))


def probed(index: Index, queries: DataFrame) -> DataFrame:
    """query, u, cell, shard: the shards of the nearest cells of each query (query, v)."""
    centres, probes, shards, dim = index.centres, index.probes, index.shards, index.dim

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = _matrix(b.column(1), dim) @ centres.T
            cells = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            rows = [(i, c, s) for i, own in enumerate(cells.tolist()) for c in own for s in range(shards.get(c, 0))]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["query", "u", "cell", "shard"])

    asked = prepared(queries, index.mean, "query").filter(F.size("u") == dim)
    return asked.mapInArrow(nearest, "query string, u array<double>, cell int, shard long")


def dealt(index: Index, queries: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """cell, shard, part, asks, track_id, u: the shards and, dealt to the parts of each cell, the queries that probe them; and the parts by cell."""
    sent = probed(index, queries)
    own = {r.cell: r["count"] for r in sent.filter("shard = 0").groupBy("cell").count().collect()}  # at most CELLS
    parts = {c: -(-n // max(ASKED, min(index.rows[c], shard_rows) // 4)) for c, n in own.items()}
    of = lambda number: F.create_map(*[F.lit(x) for pair in (number or {0: 1}).items() for x in pair])[F.col("cell")]
    shard = (F.col("salt") % of(index.shards)).cast("long").alias("shard")
    stored = index.table.filter(F.col("cell").isin(list(own))).select("cell", shard, F.explode(F.sequence(F.lit(0), of(parts) - 1)).alias("part"), F.lit(False).alias("asks"), "track_id", "u")
    part = F.pmod(F.xxhash64("query"), of(parts)).cast("int").alias("part")
    return stored.unionByName(sent.select("cell", "shard", part, F.lit(True).alias("asks"), F.col("query").alias("track_id"), "u")), parts


def search(index: Index, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query, track_id, rank, score: the k nearest of each query (query, v), without the query itself."""
    spark, dim = queries.sparkSession, index.dim
    both, _ = dealt(index, queries, shard_rows)
    placed = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "shard", "part").sortWithinPartitions("cell", "shard", "part", "asks")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for whole in batches:
            cell, shard_no, part_no = (np.asarray(whole.column(c)).astype(np.int64) for c in range(3))
            key = (cell << 48) | (shard_no << 25) | (part_no << 1) | np.asarray(whole.column(3).cast(pa.int8()))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, number = whole.slice(a, b - a), int(key[a]) >> 1
                if number != now:
                    now, held, shard = number, [], None
                if not key[a] & 1:
                    held.append(part)
                elif held:
                    shard = shard or _Shard([i for b in held for i in b.column(4).to_pylist()], np.concatenate([_matrix(b.column(5), dim) for b in held]))
                    for i in range(0, part.num_rows, BLOCK):
                        block = part.slice(i, BLOCK)
                        yield shard.answers(block.column(4), _matrix(block.column(5), dim), k)

    found = placed.mapInArrow(best, "query string, track_id string, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "track_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "track_id", "rank", "score")


def sendable(index: Index, most: int = SENT_BYTES) -> bool:
    """Whether all of index can be sent to every task."""
    return len(index.centres) == 1 and index.mean is None and sum(index.rows.values()) * index.dim * 8 <= most


def sent(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, track_id, score: what search finds for queries (query, v), each of its own id, by a sendable index that every task holds."""
    dim = index.dim
    rows = index.table.select("track_id", "u").toArrow()
    whole = queries.sparkSession.sparkContext.broadcast((rows.column("track_id").to_pylist(), _matrix(rows.column("u").combine_chunks(), dim)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(*whole.value)
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False))
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x = _matrix(part.column(1), dim).astype(np.float64)
                fine = np.isfinite(x).all(1) & (np.abs(x) > 1e-9).any(1) & part.column(0).is_valid().to_numpy(zero_copy_only=False)
                x = x[fine]
                yield shard.answers(part.column(0).filter(pa.array(fine)), x / np.sqrt((x * x).sum(1))[:, None], k)

    return queries.select("query", "v").mapInArrow(best, "query string, track_id string, score double")


class _Shard:
    def __init__(self, ids: list[str], x: np.ndarray) -> None:
        self.x = x
        ids = np.array(ids, object)
        self.place = np.argsort(np.argsort(ids, kind="stable"))
        self.ids = pa.array(ids, pa.string())
        self.own: dict[str, list[int]] = {}
        for at, name in enumerate(ids):
            self.own.setdefault(name, []).append(at)

    def answers(self, names: pa.Array, u: np.ndarray, k: int) -> pa.RecordBatch:
        """query, track_id, score: the k best for each query (names and u) but itself."""
        score = np.round(u @ self.x.T, 9)
        found, scores, counts = [], [], []
        for name, own in zip(names.to_pylist(), score, strict=True):
            itself = self.own.get(name, ())
            at = np.arange(len(own))
            most = k + len(itself)
            if len(own) > most:
                at = np.flatnonzero(own >= np.partition(own, len(own) - most)[len(own) - most])
            if itself:
                at = at[~np.isin(at, itself)]
            at = at[np.lexsort((self.place[at], -own[at]))][:k]
            found.append(at)
            scores.append(own[at])
            counts.append(len(at))
        of = pa.array(np.repeat(np.arange(len(counts)), counts))
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        return pa.RecordBatch.from_arrays([names.cast(pa.string()).take(of), self.ids.take(pa.array(join(found, np.int64).astype(np.int64))), pa.array(join(scores, np.float64))], ["query", "track_id", "score"])


def neighbours(df: DataFrame, k: int = 10, centred: bool = False, flat_below: int = FLAT_BELOW) -> DataFrame:
    """The k nearest of every vector of df."""
    index = build(df, centred, flat_below)
    if index is None:
        return df.sparkSession.createDataFrame([], "query string, track_id string, rank int, score double")
    return search(index, df.select(F.col("track_id").alias("query"), "v"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours that were found."""
    return found.join(exact.select("query", "track_id"), ["query", "track_id"], "left_semi").count() / max(1, exact.count())
