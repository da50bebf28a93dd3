"""Scoring by a gated recurrent language model with a class-factored output.

The vocabulary is counted over all training tokens. The FREQUENT commonest words
have outputs of their own, in classes of CLASS words; every other word belongs to
one of RARE classes by its ending and has its smoothed unigram share of it. So
P(word) = P(class | state) * P(word | class, state), with a word never seen in
training as one further word of its class. Training documents are dealt to groups
by a hash of id and text. Each group trains on all of its documents by truncated
backpropagation through every window, in a fixed order and from a common start,
and the weights of the groups are averaged: they do not depend on how Spark splits
the input. State is carried across windows in training and scoring, so a score is
the log-likelihood of the complete document.

Words are 64-bit hashes. What a block of documents needs of the counts is joined
by hash and gathered by block, so no table that grows is broadcast.

Defined cases: a null or empty text is its end token alone; rows that repeat are
counted and scored each; equal counts are ordered by hash; without training
documents all counts are 0 and the model is uniform over its classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, U64, chunks, partitions, picked, span_hashes, spans, text_buffer, written
from .toxicity import held_out

FREQUENT, CLASS, RARE = 512, 32, 48
HIDDEN, WINDOW, BATCH = 16, 16, 1024
#: Documents scored side by side.
SCORE_BATCH = 3072
RATE = 0.08
#: Bytes of text in a block that is scored by one task, and in a group that one model trains on, about.
BLOCK_BYTES, GROUP_BYTES = 12 << 20, 16 << 20
#: Buckets of word hashes in which counts meet the blocks that want them: at least, and bytes of text for each more.
BUCKETS, BUCKET_BYTES = 256, 128 << 20
#: Groups whose weights are added up by one task.
FAN = 64
#: Documents that the common start is fitted on, about; its passes; and the most bytes of each, which bound what the driver holds.
START_DOCS, START_ROUNDS, START_BYTES = 1000, 3, 1 << 16
#: Bytes of text between two passes of a group's training over batches of like length.
CHUNK = 8 << 20
END = np.int64(-7046029254386353131)
_IN_TOKEN = np.ones(256, bool)
_IN_TOKEN[[32, *range(9, 14)]] = False
_HEADS = FREQUENT // CLASS


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and rare class of every token in document order, ends included, and where each document's begin."""
    parts = [_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 1 << 19)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)
    h, kind, sizes = (np.concatenate(x) for x in zip(*((h, kind, np.diff(first)) for h, kind, first in parts), strict=True))
    return h, kind, np.concatenate([[0], np.cumsum(sizes)])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, doc = spans(_IN_TOKEN[low], offsets)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1)) + np.arange(n + 1)
    h, kind = np.full(first[-1], END), np.zeros(first[-1], np.int32)
    at = np.arange(len(starts)) + doc
    h[at] = span_hashes(low, starts, ends).view(np.int64)
    last, before = low[ends - 1].astype(np.int64), low[np.maximum(ends - 2, starts)].astype(np.int64)
    kind[at] = (last * 31 + before * 7) % RARE
    return h, kind, first


def _packed(buckets: int, h: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of hashes, its arrays as bytes; h is made distinct already."""
    bucket = (h.view(U64) % U64(buckets)).astype(np.int32)
    order = np.lexsort((h, bucket))
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(h) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(h)][: len(cuts)]
    columns = [pa.array([x[order[a:b]].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (h, *more)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]]), *columns], ["bucket", *_PACKED[: len(columns)]])


_PACKED = ("h", "c", "kind")


def _merged(h: np.ndarray, c: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(inverse, c, len(u)).astype(np.int64), kind[at]


def _joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _counted(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, h, c, kind: the counts of all tokens, added up in each task first; a row for each bucket of hashes."""
    kinds = "bucket int, h binary, c binary, kind binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            offsets, data = text_buffer(batch.column(0))
            for i, j in chunks(offsets):
                h, kind, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(_merged(h, np.ones(len(h)), kind))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield _packed(buckets, *held[0])
                        held, size = [], 0
        if held:
            yield _packed(buckets, *_merged(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def add(t: pa.Table) -> pa.Table:
        h, c, kind = _merged(*(_joined(t.column(n), k) for n, k in zip(_PACKED, (np.int64, np.int64, np.int32), strict=True)))
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "h": pa.array([h.tobytes()]), "c": pa.array([c.tobytes()]), "kind": pa.array([kind.tobytes()])})

    return docs.mapInArrow(run, kinds).groupBy("bucket").applyInArrow(add, kinds)


def _totals(counts: DataFrame, frequent: np.ndarray) -> list:
    """kind, n, v over all words, and rare_n, rare_v over those that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, c, kind = (np.frombuffer(b.column(i)[k].as_py(), t) for i, t in ((1, np.int64), (2, np.int64), (3, np.int32)))
                rare = ~np.isin(h, frequent)
                sums = [np.bincount(kind[m], w[m], RARE).astype(np.int64) for m in (np.ones(len(h), bool), rare) for w in (c, np.ones(len(h)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE, dtype=np.int32)), *map(pa.array, sums)], ["kind", "n", "v", "rare_n", "rare_v"])

    rows = counts.mapInArrow(run, "kind int, n long, v long, rare_n long, rare_v long")
    return rows.groupBy("kind").agg(*(F.sum(x).alias(x) for x in ("n", "v", "rare_n", "rare_v"))).collect()


def _commonest(counts: DataFrame, most: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, c = (np.frombuffer(b.column(i)[k].as_py(), np.int64) for i in (1, 2))
                top = np.lexsort((h, -c))[:most]
                yield pa.RecordBatch.from_arrays([pa.array(h[top]), pa.array(c[top])], ["h", "c"])

    top = counts.mapInArrow(run, "h long, c long").orderBy(F.desc("c"), "h").limit(most)
    return np.array([r.h for r in top.collect()], np.int64)


class Model:
    """Input rows are frequent words, then rare classes; output classes likewise, _HEADS of words and then RARE."""

    def __init__(self, words: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.words = np.sort(words)
        self.rank = np.argsort(words, kind="stable")
        h = HIDDEN
        self.w = {"x": init(FREQUENT + RARE, 3 * h), "u": init(h, 3 * h), "b": np.zeros(3 * h, np.float32), "c": init(h, _HEADS + RARE), "d": np.zeros(_HEADS + RARE, np.float32), "f": init(_HEADS, h, CLASS), "g": np.zeros((_HEADS, CLASS), np.float32)}
        self.grown = {k: np.full_like(v, 1e-6) for k, v in self.w.items()}

    def index(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The input row of each token."""
        out = FREQUENT + kind.astype(np.int64)
        if len(self.words):
            slot = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[slot] == h
            out[known] = self.rank[slot[known]]
        return out

    def _gates(self, w: np.ndarray) -> np.ndarray:
        """Columns for the two gates and the candidate, each for itself."""
        return np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2))

    def _step(self, x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and what the reset gate met; x, the input's share, becomes both gates and the candidate."""
        a = np.matmul(h, u)
        zr, n = x[:2], x[2]
        zr += a[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n += zr[1] * a[2]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[0]
        new += n
        return new, a[2]

    def _exp(self, logits: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of logits, in place, and its sums by row; taken from the greatest first where they could overflow."""
        shift = np.zeros((len(logits), 1), np.float32)
        if float((np.abs(c).sum(0) + np.abs(d)).max()) > 60:  # states lie between -1 and 1
            shift = logits.max(1, keepdims=True)
            logits -= shift
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
        return total, np.log(total) + shift[:, 0]

    def outputs(self, h: np.ndarray, row: np.ndarray, gradients: bool = False) -> tuple:
        """ln P(class) + ln P(word | class) of frequent words, ln P(class) of rare ones; and the gradient of its negative."""
        w = self.w
        order = np.argsort(row.astype(np.int16), kind="stable")
        h, row = h[order], row[order]
        at = np.arange(len(row))
        kind = np.where(row < FREQUENT, row // CLASS, _HEADS + row - FREQUENT)
        e = h @ w["c"]
        e += w["d"]
        ln = e[at, kind]
        total, log = self._exp(e, w["c"], w["d"])
        ln -= log
        if gradients:
            e *= (1 / total)[:, None]
            e[at, kind] -= 1
            grad = {"c": h.T @ e, "d": np.ones(len(e), np.float32) @ e, "f": np.zeros_like(w["f"]), "g": np.zeros_like(w["g"])}
            dh = e @ w["c"].T
        cuts = np.searchsorted(row, np.arange(_HEADS + 1) * CLASS).tolist()
        for k in range(_HEADS):
            own = slice(cuts[k], cuts[k + 1])
            n = cuts[k + 1] - cuts[k]
            if not n:
                continue
            p = h[own] @ w["f"][k]
            p += w["g"][k]
            local, rows = row[own] % CLASS, at[:n]
            some = p[rows, local]
            sums, log = self._exp(p, w["f"][k], w["g"][k])
            ln[own] += some - log
            if gradients:
                p *= (1 / sums)[:, None]
                p[rows, local] -= 1
                grad["f"][k], grad["g"][k] = h[own].T @ p, np.ones(n, np.float32) @ p
                dh[own] += p @ w["f"][k].T
        back = np.empty_like(ln)
        back[order] = ln
        if not gradients:
            return (back,)
        dh_back = np.empty_like(dh)
        dh_back[order] = dh
        return back, dh_back, grad

    def _update(self, grad: dict[str, np.ndarray], n: int, rate: float) -> None:
        for k, g in grad.items():
            g = g / n
            self.grown[k] += g * g
            self.w[k] -= rate * g / np.sqrt(self.grown[k])

    def train(self, rows: np.ndarray, first: np.ndarray, rate: float = RATE) -> None:
        """One pass over documents (rows[first[d]:first[d + 1]]) in batches of like length."""
        for docs, seen, live in _lanes(rows, first, BATCH):
            h = np.zeros((len(docs), HIDDEN), np.float32)
            for t in range(0, seen.shape[0], WINDOW):
                part, on = seen[t : t + WINDOW], live[t : t + WINDOW]
                h = self._window(part[on], on.sum(1).tolist(), h, rate)

    def _window(self, row: np.ndarray, counts: list[int], h: np.ndarray, rate: float) -> np.ndarray:
        """Scores each token from the state before it, then goes back through the window; at each step the first of the lanes go on."""
        k, w = HIDDEN, self.w
        cuts = np.r_[0, np.cumsum(counts)].tolist()
        h = h[: counts[0]].copy()
        x, u = np.take(self._gates(w["x"] + w["b"]), row, axis=1), self._gates(w["u"])
        states, met = np.empty((len(row), k), np.float32), np.empty((len(row), k), np.float32)
        for s, m in enumerate(counts):
            at = slice(cuts[s], cuts[s + 1])
            states[at] = h[:m]
            h[:m], met[at] = self._step(x[:, at], u, states[at])
        _, dh, grad = self.outputs(states, row, gradients=True)
        z, r, n = x
        # what a step's gradient is multiplied by, for all steps at once
        to_n = (1 - z) * (1 - n * n)
        to_z = (states - n) * z * (1 - z)
        to_r = met * r * (1 - r)
        da, dn = np.empty_like(x), np.empty_like(states)
        carried = np.zeros_like(h)
        back = np.ascontiguousarray(u.transpose(0, 2, 1))
        for s in range(len(counts) - 1, -1, -1):
            at, d = slice(cuts[s], cuts[s + 1]), carried[: counts[s]]
            own = np.multiply(d, to_n[at], out=dn[at])
            a = da[:, at]
            np.multiply(d, to_z[at], out=a[0])
            np.multiply(own, to_r[at], out=a[1])
            np.multiply(own, r[at], out=a[2])
            d *= z[at]
            for gate in range(3):
                d += a[gate] @ back[gate]
            d += dh[at]
        du = np.concatenate([states.T @ part for part in da], axis=1)
        da = np.concatenate([da[0], da[1], dn], axis=1)
        order = np.argsort(row.astype(np.int16), kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
        sums = np.add.reduceat(da[order], heads)
        which, n = row[order][heads], len(row)
        g = sums / n
        self.grown["x"][which] += g * g
        w["x"][which] -= rate * g / np.sqrt(self.grown["x"][which])
        self._update(grad | {"u": du, "b": sums.sum(0)}, n, rate)
        return h

    def score(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """ln P of every token, given all before it in its document (rare words: of their class)."""
        out = np.zeros(len(rows))
        table, u = self._gates(self.w["x"] + self.w["b"]), self._gates(self.w["u"])
        for docs, seen, live in _lanes(rows, first, SCORE_BATCH):
            h = np.zeros((len(docs), HIDDEN), np.float32)
            for t in range(0, seen.shape[0], WINDOW):
                part, on = seen[t : t + WINDOW], live[t : t + WINDOW]
                row, counts = part[on], on.sum(1).tolist()
                cuts = np.r_[0, np.cumsum(counts)].tolist()
                x, states = np.take(table, row, axis=1), np.empty((len(row), HIDDEN), np.float32)
                for s, m in enumerate(counts):
                    at = slice(cuts[s], cuts[s + 1])
                    states[at] = h[:m]
                    h[:m] = self._step(x[:, at], u, states[at])[0]
                s, d = np.nonzero(on)
                out[first[docs[d]] + t + s] = self.outputs(states, row)[0]
        return out


def _lanes(rows: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like length side by side, longest first: ids, tokens by step and document, and which are tokens."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, int(sizes[order[at]]))
        docs = order[at : at + max(8, min(width, 2_000_000 // longest))]
        at += len(docs)
        docs = docs[sizes[docs] > 0]
        if not len(docs):
            break
        step = np.arange(longest)[:, None]
        live = step < sizes[docs]
        seen = np.zeros(live.shape, np.int64)
        seen[live] = rows[(first[docs] + np.minimum(step, sizes[docs] - 1))[live]]
        yield docs, seen, live


def _averaged(docs: DataFrame, start: Model, groups: int = 1) -> dict[str, np.ndarray]:
    """Weights after each group trained on its documents (id, text) from the same start, averaged by tokens."""
    names = list(start.w)
    shared = docs.sparkSession.sparkContext.broadcast(start)
    group = F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("long").alias("part")

    def fresh() -> Model:
        model = Model(shared.value.words)
        model.w = {k: v.copy() for k, v in shared.value.w.items()}
        model.rank, model.grown = shared.value.rank, {k: v.copy() for k, v in shared.value.grown.items()}
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by group, id and text; a model trains whenever its group has filled a chunk, whatever the batches."""
        own, model, n, held, size = None, None, 0, [], 0

        def train() -> int:
            if not held:
                return 0
            offsets = np.cumsum([0, *map(len, held)])
            h, kind, first = tokens(np.frombuffer(b"".join(held), np.uint8), offsets)
            model.train(model.index(h, kind), first)
            return len(h)

        def done() -> pa.RecordBatch:
            return _sum(own, [(n, np.concatenate([model.w[k].reshape(-1) for k in names]) * np.float64(n))])

        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != own or size >= CHUNK:
                    n += train()
                    held, size = [], 0
                    if part != own:
                        if own is not None:
                            yield done()
                        own, model, n = part, fresh(), 0
                held.append(text.encode())
                size += len(held[-1]) + 1
        if own is not None:
            n += train()
            yield done()

    def add(t: pa.Table) -> pa.Table:
        got = sorted(zip(t.column("part").to_pylist(), t.column("n").to_pylist(), t.column("w").to_pylist(), strict=True), key=lambda x: x[0])
        return pa.Table.from_batches([_sum(got[0][0] // FAN, [(n, np.frombuffer(w, np.float64)) for _, n, w in got])])

    kind = "part long, n long, w binary"
    dealt = docs.select(group, "text", "id").repartition(max(groups, partitions(docs.sparkSession)), "part").sortWithinPartitions("part", "id", "text").select("part", "text")
    total = written(dealt.mapInArrow(run, kind), "lm-weights")
    while groups > 1:
        total, groups = total.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(add, kind), -(-groups // FAN)
    rows = total.collect()  # one
    if not rows:
        return start.w
    flat, out, at = np.frombuffer(rows[0].w, np.float64) / rows[0].n, {}, 0
    for k in names:
        size = start.w[k].size
        out[k] = flat[at : at + size].reshape(start.w[k].shape).astype(np.float32)
        at += size
    return out


def _sum(part: int, parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    w = parts[0][1].copy()
    for _, x in parts[1:]:
        w += x
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sum(n for n, _ in parts)], pa.int64()), pa.array([w.astype(np.float64).tobytes()], pa.binary())], ["part", "n", "w"])


def score(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row."""
    spark = docs.sparkSession
    every = picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("out", held_out("id", folds, fold))
    every = every.withColumn("text", F.coalesce("text", F.lit("")))
    training = every.filter("not out").select("id", "text")
    size = every.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("long") + 40), F.lit(0)).alias("bytes")).first()
    buckets = BUCKETS + size.bytes // BUCKET_BYTES
    counts = written(_counted(training.select("text"), buckets), "lm-counts")
    frequent = _commonest(counts, FREQUENT)
    model = Model(frequent)
    rare_n, rare_v, n_all, v_all = np.zeros(RARE), np.zeros(RARE), 0, 0
    for r in _totals(counts, frequent):
        rare_n[r.kind], rare_v[r.kind] = r.rare_n, r.rare_v
        n_all, v_all = n_all + r.n, v_all + r.v
    sampled = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, size.rows // START_DOCS))) == 0
    some = [r.text for r in training.filter(sampled & (F.octet_length("text") <= START_BYTES)).orderBy("id", "text").limit(2 * START_DOCS).collect()]
    if some:
        offsets, data = text_buffer(pa.array(some))
        h, kind, first = tokens(data, offsets)
        for _ in range(START_ROUNDS):
            model.train(model.index(h, kind), first)
        model.w = _averaged(training, model, max(1, -(-size.bytes // GROUP_BYTES)))
    blocks = max(1, -(-size.bytes // BLOCK_BYTES))
    # rows that repeat are told apart by their place in the input: a score does not depend on its block
    dealt = every.withColumn("block", F.pmod(F.xxhash64("id", "text") + F.monotonically_increasing_id(), F.lit(blocks)).cast("int")).repartition(max(blocks, partitions(spark)), "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            offsets, data = text_buffer(batch.column(0))
            own = np.asarray(batch.column(1))
            for i, j in chunks(offsets):
                h, _, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                block = np.repeat(own[i:j], np.diff(first))
                for b in np.unique(own[i:j]).tolist():
                    seen.setdefault(b, []).append(np.unique(h[block == b]))
        for b, lists in seen.items():
            rows = _packed(buckets, np.unique(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(rows.num_rows, b, np.int32)), rows.column(1)], ["bucket", "block", "h"])

    def looked_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known, c = (_joined(right.column(n), np.int64) for n in ("h", "c"))
        out: tuple[list, list] = ([], [])
        for raw in left.column("h").to_pylist():
            h = np.frombuffer(raw, np.int64)
            slot = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            hit = known[slot] == h if len(known) else np.zeros(len(h), bool)
            out[0].append(h[hit].tobytes())
            out[1].append(c[slot[hit]].tobytes() if len(known) else b"")
        return pa.table({"block": left.column("block"), "h": pa.array(out[0], pa.binary()), "c": pa.array(out[1], pa.binary())})

    words_of = dealt.select("text", "block").mapInArrow(distinct, "bucket int, block int, h binary")
    wanted = words_of.groupBy("bucket").cogroup(counts.select("bucket", "h", "c").groupBy("bucket")).applyInArrow(looked_up, "block int, h binary, c binary")
    shared = spark.sparkContext.broadcast((model, rare_n, rare_v))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model, rare_n, rare_v = shared.value
        h_known, c_known = (_joined(right.column(n), np.int64) for n in ("h", "c"))
        order = np.argsort(h_known)
        h_known, c_known = h_known[order], c_known[order].astype(float)
        offsets, data = text_buffer(left.column("text"))
        out = []
        for i, j in chunks(offsets, 8 << 20):
            h, kind, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            c = np.zeros(len(h))
            if len(h_known):
                slot = np.minimum(np.searchsorted(h_known, h), len(h_known) - 1)
                hit = h_known[slot] == h
                c[hit] = c_known[slot[hit]]
            base = np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
            row = model.index(h, kind)
            ln = model.score(row, first)
            rare = row >= FREQUENT
            k = row[rare] - FREQUENT
            ln[rare] += np.log((c[rare] + 0.5) / (rare_n[k] + 0.5 * (rare_v[k] + 1)))
            add = lambda x, at=first[:-1]: np.add.reduceat(x, at)
            out.append((np.diff(first), add((c > 0).astype(np.int64)), add(base), add(ln) / np.log(10)))
        n, known, base, score = (np.concatenate(x) for x in zip(*out, strict=True))
        full = pa.array(np.full(len(n), n_all, np.int64))
        return pa.table({"id": left.column("id"), "held_out": left.column("out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": full, "base_score": pa.array(base), "score": pa.array(score)})

    def either(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key, left, right) if left.num_rows else _nothing()

    done = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(either, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", id_col)


def _nothing() -> pa.Table:
    kinds = {"id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    return pa.table({k: pa.array([], t) for k, t in kinds.items()})
