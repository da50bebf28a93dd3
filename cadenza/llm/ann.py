"""Nearest neighbours by inner product: score-aware anisotropic codes, table scans, exact reranking.

Vectors are cut into two-dimensional parts, each coded by four bits. Centres and
codes minimise the loss |r|^2 + (eta - 1) (r . x/|x|)^2 of the residual r = x - code,
so that error along the vector, which moves large inner products, costs eta times
as much as error across it. Centres are fitted on at most SAMPLE vectors; every
vector is coded. The index is dealt to shards; queries are sent to every shard in
one job and scan its codes by table look-up. What may be among the best of a shard
is scored exactly in double precision: all vectors whose rough score comes within
a margin of the k-th best exact one, where the margin covers the errors that the
codes make on near vectors of the sample. The best of all shards are merged by query.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do null ids or vectors of another length than most;
rows that repeat (id and vector) count once; equal scores go to the smaller id;
copies of a vector are searched as one and expanded to their ids; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import partitions, picked, written

CENTRES, PART = 16, 2
#: Most vectors that centres are fitted on.
SAMPLE = 20_000
#: Vectors in a shard, about.
SHARD_ROWS = 65_536
#: Vectors of a shard that are scored exactly for a query at first, to know its k-th best.
RERANK = 64
#: Share of near vectors whose error the margin covers, and vectors it is measured with.
COVERED, PROBES = 0.99, 256
ETA = 4.0
_SALTS = 1024


class Codec:
    """Four-bit centres for each part of a vector."""

    def __init__(self, dim: int, eta: float = ETA) -> None:
        self.dim, self.eta = dim, eta
        self.parts = -(-dim // PART)
        self.parts += self.parts % 2
        self.centres = np.zeros((self.parts, CENTRES, PART))
        self.margin = 0.0

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.zeros((len(x), self.parts * PART))
        padded[:, : self.dim] = x
        unit = padded / np.linalg.norm(padded, axis=1, keepdims=True)
        return padded.reshape(len(x), self.parts, PART), unit.reshape(len(x), self.parts, PART)

    def _residuals(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return x - self.centres[np.arange(self.parts), codes]

    def _choose(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray, along: np.ndarray) -> None:
        """One round of coordinate descent over the parts; along is r . x/|x| of each vector."""
        for s in range(self.parts):
            r = x[:, s, None, :] - self.centres[s]
            p = np.einsum("nkd,nd->nk", r, unit[:, s])
            rest = along - p[np.arange(len(x)), codes[:, s]]
            codes[:, s] = np.argmin((r * r).sum(2) + (self.eta - 1) * (rest[:, None] + p) ** 2, axis=1)
            along[:] = rest + p[np.arange(len(x)), codes[:, s]]

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 7) -> Codec:
        parts, unit = self._split(x)
        picks = np.random.default_rng(seed).integers(0, len(x), (self.parts, CENTRES))
        for s in range(self.parts):
            self.centres[s] = parts[picks[s], s]
        codes = self._plain(parts)
        for _ in range(rounds):
            along = (self._residuals(parts, codes) * unit).sum((1, 2))
            self._choose(parts, unit, codes, along)
            for s in range(self.parts):
                r = parts[:, s] - self.centres[s, codes[:, s]]
                target = along - (r * unit[:, s]).sum(1) + (parts[:, s] * unit[:, s]).sum(1)
                for k in range(CENTRES):
                    m = codes[:, s] == k
                    if m.any():
                        u = unit[m, s]
                        left = m.sum() * np.eye(PART) + (self.eta - 1) * u.T @ u
                        self.centres[s, k] = np.linalg.solve(left, parts[m, s].sum(0) + (self.eta - 1) * (u * target[m, None]).sum(0))
                r = parts[:, s] - self.centres[s, codes[:, s]]
                along = target - (parts[:, s] * unit[:, s]).sum(1) + (r * unit[:, s]).sum(1)
        return self

    def measure(self, x: np.ndarray, k: int) -> Codec:
        """Sets margin: by how much codes understate the inner products of near vectors, for a query of length 1."""
        codes, short = np.ascontiguousarray(self.encode(x).T), []
        for q in x[:: max(1, len(x) // PROBES)]:
            exact = (x * q).sum(1)
            near = np.argpartition(exact, len(x) - min(k, len(x)))[-min(k, len(x)) :]
            short.append((exact[near] - scan(self, codes, q)[near]) / np.linalg.norm(q))
        self.margin = max(0.0, float(np.quantile(np.concatenate(short), COVERED)))
        return self

    def _plain(self, parts: np.ndarray) -> np.ndarray:
        return np.stack([((parts[:, s, None, :] - self.centres[s]) ** 2).sum(2).argmin(1) for s in range(self.parts)], axis=1)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Two codes a byte."""
        out = np.zeros((len(x), self.parts // 2), np.uint8)
        for i in range(0, len(x), 2048):
            parts, unit = self._split(x[i : i + 2048])
            codes = self._plain(parts)
            for _ in range(rounds):
                self._choose(parts, unit, codes, (self._residuals(parts, codes) * unit).sum((1, 2)))
            out[i : i + 2048] = codes[:, 0::2] | codes[:, 1::2] << 4
        return out

    def tables(self, query: np.ndarray) -> np.ndarray:
        """What each byte of codes adds to the inner product with query."""
        padded = np.zeros(self.parts * PART)
        padded[: self.dim] = query
        t = np.einsum("skd,sd->sk", self.centres, padded.reshape(self.parts, PART))
        return (t[0::2, None, :] + t[1::2, :, None]).reshape(self.parts // 2, 256).astype(np.float32)


def scan(codec: Codec, codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Approximate inner products of query with all coded vectors; codes: a row of bytes for each pair of parts."""
    score = np.zeros(codes.shape[1], np.float32)
    for table, column in zip(codec.tables(query), codes, strict=True):
        score += table[column]
    return score


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = picked(df, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def build_index(vectors: DataFrame, dim: int, keep: int) -> tuple[Codec, DataFrame]:
    """The codec, and a written table of distinct vectors: ids (their keep smallest), v, codes."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    sample = np.array(some["v"].tolist(), float)
    codec = Codec(dim).fit(sample).measure(sample, keep)
    part = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    first = vectors.groupBy("v", part.alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"))
    classes = first.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = codec.encode(_matrix(b.column(0), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["v", "ids", "codes"])

    return codec, written(classes.select("v", "ids").mapInArrow(encode, "v array<double>, ids array<long>, codes binary"), "ann-index")


class _Shard:
    def __init__(self, codec: Codec, rows: list[pa.RecordBatch], dim: int) -> None:
        self.codec = codec
        self.x = np.concatenate([_matrix(b.column(2), dim) for b in rows])
        self.ids = pa.chunked_array([b.column(3) for b in rows]).combine_chunks()
        self.low = np.asarray(pc.list_element(self.ids, 0))
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(c for b in rows for c in b.column(4).to_pylist()), np.uint8).reshape(len(self.x), -1).T)

    def answers(self, queries: pa.RecordBatch, dim: int, k: int) -> Iterator[pa.RecordBatch]:
        x = self.x
        for qid, q in zip(np.asarray(queries.column(3).flatten()).tolist(), _matrix(queries.column(2), dim), strict=True):
            rough = scan(self.codec, self.codes, q)
            if len(rough) > RERANK:
                some = np.argpartition(rough, len(rough) - RERANK)[-RERANK:]
                least = np.partition((x[some] * q).sum(1), RERANK - k)[RERANK - k] if k <= RERANK else -np.inf
                at = np.flatnonzero(rough >= min(least - self.codec.margin * np.linalg.norm(q), rough[some].min()))
            else:
                at = np.arange(len(rough))
            score = (x[at] * q).sum(1)
            top = np.lexsort((self.low[at], -score))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), qid)), pa.array(score[top]), self.ids.take(pa.array(at[top]))], ["query_id", "score", "ids"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors but the query's own id."""
    spark: SparkSession = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    base = valid_vectors(vectors, id_col, vec_col)
    dims = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    dim = dims[0].d
    codec, index = build_index(base.filter(F.size("v") == dim), dim, k + 1)
    asked = valid_vectors(queries, id_col, vec_col).filter(F.size("v") == dim).dropDuplicates(["id"])
    shards = max(1, -(-index.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(shards)).cast("int")
    stored = index.select(shard.alias("shard"), F.lit(False).alias("asks"), "v", "ids", "codes")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "v", F.array("id").alias("ids"), F.lit(None).cast("binary").alias("codes"))
    dealt = stored.unionByName(sent).repartition(max(shards, partitions(spark)), "shard").sortWithinPartitions("shard", "asks")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, its vectors before the queries."""
        own, held, made = None, [], None
        for whole in batches:
            key = np.asarray(whole.column(0)) * 2 + np.asarray(whole.column(1).cast(pa.int8()))
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                batch, number, asks = whole.slice(a, b - a), int(key[a]) // 2, bool(key[a] % 2)
                if number != own:
                    own, held, made = number, [], None
                if not asks:
                    held.append(batch)
                elif held:
                    made = made or _Shard(codec, held, dim)
                    yield from made.answers(batch, dim, k + 1)

    near = written(dealt.mapInArrow(best, "query_id long, score double, ids array<long>"), "ann-found")
    by_query = Window.partitionBy("query_id")
    near = near.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("score"), F.col("ids")[0]))).filter(F.col("n") <= k + 1)
    near = near.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    ranked = near.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
