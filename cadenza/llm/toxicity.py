"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and their beginnings, hashed to 40 bits.
A bounded sample of labelled rows is broadcast against the documents, so texts
are not shuffled; Spark counts each term in toxic and other samples, and those
whose likelihood ratio tells the two apart become features. The machine's score
is the logistic of w0 + sum w_i + sum <v_i, v_j> over the pairs of features
present, so an insult next to a group mention can weigh more than the two alone.

Defined cases: a null or empty text scores as the bias alone; rows that repeat
are scored each; null labels are not used; without labels of both kinds all
texts score the share of toxic labels (0 where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, chunks, picked, shielded, span_hashes, text_buffer, words, written

#: Most labelled rows that the machine is fitted on.
SAMPLE = 20_000
#: Most terms that become features, and the likelihood ratio that one needs at least (more where many terms are tried).
FEATURES, LEAST_RATIO = 2048, 12.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
_HASH_BITS, _FILTER_BITS = 40, 22


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (int64) and documents of all terms; a term may repeat."""
    low, starts, ends, doc = words(data, offsets)
    hashes, docs = [span_hashes(low, starts, ends)], [doc]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        hashes.append(span_hashes(low, starts[long], starts[long] + n) ^ U64(n))
        docs.append(doc[long])
    return (np.concatenate(hashes) >> U64(64 - _HASH_BITS)).astype(np.int64), np.concatenate(docs)


@dataclass
class Machine:
    """Sorted term hashes with their weights and factors."""

    bias: float = -100.0
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))

    def prepare(self) -> Machine:
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes & ((1 << _FILTER_BITS) - 1)] = True
        return self

    def margin(self, docs: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        """docs, slots: the distinct features of n documents."""
        v = self.factors[slots]
        total = np.stack([np.bincount(docs, v[:, f], n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(docs, (v * v).sum(1), n)
        return self.bias + np.bincount(docs, self.weights[slots], n) + 0.5 * ((total * total).sum(1) - squares)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.hashes):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        h, doc = terms(data, offsets)
        near = np.flatnonzero(self.filter[h & ((1 << _FILTER_BITS) - 1)])
        slot = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        near, slot = near[self.hashes[slot] == h[near]], slot[self.hashes[slot] == h[near]]
        both = np.unique(doc[near] * len(self.hashes) + slot)
        return 1 / (1 + np.exp(-self.margin(both // len(self.hashes), both % len(self.hashes), n)))

    def fit(self, docs: np.ndarray, slots: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.2, ridge: float = 2e-5, seed: int = 5) -> Machine:
        """Adagrad on the logistic loss over all samples; docs is sorted."""
        m, n = len(self.hashes), len(y)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        self.weights = np.zeros(m)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (m, 8))
        gw, gv, gb = np.full(m, 1e-8), np.full((m, 8), 1e-8), 1e-8
        for _ in range(rounds):
            v = self.factors[slots]
            total = np.stack([np.bincount(docs, v[:, f], n) for f in range(8)], axis=1)
            error = (1 / (1 + np.exp(-self.margin(docs, slots, n))) - y) / n
            e = error[docs]
            dw = np.bincount(slots, e, m) + ridge * self.weights
            pull = e[:, None] * (total[docs] - v)
            dv = np.stack([np.bincount(slots, pull[:, f], m) for f in range(8)], axis=1) + ridge * 10 * self.factors
            db = error.sum()
            gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
            self.weights -= rate * dw / np.sqrt(gw)
            self.factors -= 0.1 * rate * dv / np.sqrt(gv)
            self.bias -= rate * db / np.sqrt(gb)
        return self


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine fitted on at most sample labelled rows outside the held-out fold."""
    known = picked(labels, id_col, label_col).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    some = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    joined = picked(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(some), "_id").select("_y", "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                h, doc = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(h))], ["y", "terms"])

    sampled = written(joined.mapInArrow(extract, "y int, terms array<long>").withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    totals = sampled.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = totals.n, totals.pos or 0
    if not 0 < pos < n:
        return Machine(bias=float(np.clip(np.log((pos / n) / (1 - pos / n)), -100, 100)) if n and pos < n and pos else (100.0 if n and pos == n else -100.0)).prepare()
    counted = sampled.select("y", F.explode("terms").alias("h")).groupBy("h").agg(F.sum("y").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("c"))
    a, c, share = F.col("a"), F.col("c"), pos / n
    gain = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    ratio = 2 * (gain(a, c * share) + gain(c - a, c * (1 - share)) + gain(pos - a, (n - c) * share) + gain(n - pos - c + a, (n - c) * (1 - share)))
    counted = written(counted.filter("c >= 3"), "toxicity-terms")
    least = max(LEAST_RATIO, 2 * np.log(max(1, counted.count())))
    best = counted.withColumn("ratio", ratio).filter(F.col("ratio") >= float(least)).orderBy(F.desc("ratio"), "h").limit(FEATURES).select("h")
    hashes = np.sort(np.array([r.h for r in best.collect()], np.int64))
    machine = Machine(hashes=hashes)
    if not len(hashes):
        machine.bias = float(np.log(share / (1 - share)))
        return machine.prepare()
    features = sampled.select("row", "y", F.array_intersect("terms", F.array(*[F.lit(int(h)) for h in hashes]) if len(hashes) <= 64 else _literal(hashes)).alias("f")).toPandas()
    docs_of = np.repeat(np.arange(len(features)), features["f"].map(len))
    slots = np.searchsorted(hashes, np.concatenate([np.zeros(0, np.int64), *features["f"]]).astype(np.int64))
    return machine.fit(docs_of, slots, features["y"].to_numpy(float)).prepare()


def _literal(hashes: np.ndarray) -> F.Column:
    """An array constant, parsed as one literal."""
    return F.from_json(F.lit("[" + ",".join(map(str, hashes.tolist())) + "]"), "array<long>")


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs with toxicity_score double from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(at).cast(pa.string()))
            for i, j in chunks(offsets):
                s = shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(s)], [*batch.schema.names, "toxicity_score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, toxicity_score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    machine = train(docs, labels)
    return shielded(docs, lambda d: score(d, machine).filter(F.col("toxicity_score") < threshold).drop("toxicity_score"))
