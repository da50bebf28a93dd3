"""Next tracks by causal self-attention over what a user played last.

Blocks of attention and of a small network over the embeddings of tracks and places;
the score of a next track is the inner product with its embedding. Weights are trained
by Adam on a bounded sample of sessions, held as one broadcast value, and applied to the
last tracks of every user in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import sessions

#: Width, heads, blocks and longest sequence.
WIDTH, HEADS, BLOCKS, LONGEST = 64, 4, 2, 50
#: Most sessions that weights are trained on, and most tracks among them that may be predicted.
SAMPLE, TRACKS = 4000, 20_000
EPOCHS, BATCH, RATE = 12, 64, 0.003
PLAYED = "event_type IN ('play_start', 'play_end')"


def _norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    m = x - x.mean(-1, keepdims=True)
    s = 1 / np.sqrt((m * m).mean(-1, keepdims=True) + 1e-6)
    return g * m * s + b, (m * s, s, g)


def _norm_back(d: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, s, g = kept
    e = d * g
    axes = tuple(range(d.ndim - 1))
    return s * (e - e.mean(-1, keepdims=True) - x * (e * x).mean(-1, keepdims=True)), (d * x).sum(axes), d.sum(axes)


class Model:
    """Rows of track numbers from 1 (0 fills up at the left) to scores of the next track at each place."""

    def __init__(self, tracks: int, width: int = WIDTH, heads: int = HEADS, blocks: int = BLOCKS, longest: int = LONGEST, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.heads, self.blocks, self.longest = heads, blocks, longest
        draw = lambda *shape: rng.normal(0, 0.5 / np.sqrt(width), shape)
        self.p: dict[str, np.ndarray] = {"E": draw(tracks + 1, width), "P": 0.1 * draw(longest, width), "g": np.ones(width), "b": np.zeros(width)}
        for k in range(blocks):
            for name in ("q", "k", "v", "o"):
                self.p[f"{name}{k}"] = draw(width, width)
            self.p |= {f"1{k}": draw(width, 2 * width), f"1b{k}": np.zeros(2 * width), f"2{k}": draw(2 * width, width), f"2b{k}": np.zeros(width)}
            self.p |= {f"g{k}": np.ones(width), f"b{k}": np.zeros(width), f"h{k}": np.ones(width), f"c{k}": np.zeros(width)}

    def _split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:2], self.heads, -1).transpose(0, 2, 1, 3)

    def _merge(self, x: np.ndarray) -> np.ndarray:
        return x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, list]:
        """The last layer at each place, and what the way back needs."""
        p, n = self.p, rows.shape[1]
        hidden = (np.arange(n)[:, None] < np.arange(n)) | (rows == 0)[:, None, None, :]
        hidden = hidden & ~np.eye(n, dtype=bool)  # a filled place sees itself, so that no row is without a weight
        x, kept = p["E"][rows] + p["P"][self.longest - n :], []
        for k in range(self.blocks):
            h, n1 = _norm(x, p[f"g{k}"], p[f"b{k}"])
            q, key, v = (self._split(h @ p[f"{name}{k}"]) for name in "qkv")
            a = np.where(hidden, -1e9, q @ key.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]))
            a = np.exp(a - a.max(-1, keepdims=True))
            a /= a.sum(-1, keepdims=True)
            o = self._merge(a @ v)
            x = x + o @ p[f"o{k}"]
            h2, n2 = _norm(x, p[f"h{k}"], p[f"c{k}"])
            u = h2 @ p[f"1{k}"] + p[f"1b{k}"]
            r = np.maximum(u, 0)
            x = x + r @ p[f"2{k}"] + p[f"2b{k}"]
            kept.append((h, n1, q, key, v, a, o, h2, n2, r))
        y, last = _norm(x, p["g"], p["b"])
        return y, [*kept, last]

    def loss(self, rows: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of each next track, and the gradient of every weight."""
        p, inputs, wanted = self.p, rows[:, :-1], rows[:, 1:]
        y, kept = self.forward(inputs)
        at = wanted > 0
        scores = y[at] @ p["E"].T
        scores[:, 0] = -1e9
        scores -= scores.max(1, keepdims=True)
        share = np.exp(scores)
        share /= share.sum(1, keepdims=True)
        true = wanted[at]
        n = max(1, len(true))
        value = -float(np.log(share[np.arange(len(true)), true] + 1e-12).sum()) / n
        share[np.arange(len(true)), true] -= 1
        share /= n
        g = {name: np.zeros_like(w) for name, w in p.items()}
        g["E"] += share.T @ y[at]
        dy = np.zeros_like(y)
        dy[at] = share @ p["E"]
        dx, g["g"], g["b"] = _norm_back(dy, kept[-1])
        flat = lambda a: a.reshape(-1, a.shape[-1])
        for k in reversed(range(self.blocks)):
            h, n1, q, key, v, a, o, h2, n2, r = kept[k]
            g[f"2{k}"], g[f"2b{k}"] = flat(r).T @ flat(dx), dx.sum((0, 1))
            du = (dx @ p[f"2{k}"].T) * (r > 0)
            g[f"1{k}"], g[f"1b{k}"] = flat(h2).T @ flat(du), du.sum((0, 1))
            back, g[f"h{k}"], g[f"c{k}"] = _norm_back(du @ p[f"1{k}"].T, n2)
            dx = dx + back
            g[f"o{k}"] = flat(o).T @ flat(dx)
            do = self._split(dx @ p[f"o{k}"].T)
            dv, da = a.transpose(0, 1, 3, 2) @ do, do @ v.transpose(0, 1, 3, 2)
            ds = a * (da - (da * a).sum(-1, keepdims=True)) / np.sqrt(q.shape[-1])
            dq, dk = ds @ key, ds.transpose(0, 1, 3, 2) @ q
            dh = np.zeros_like(h)
            for name, d in (("q", dq), ("k", dk), ("v", dv)):
                m = self._merge(d)
                g[f"{name}{k}"] = flat(h).T @ flat(m)
                dh += m @ p[f"{name}{k}"].T
            back, g[f"g{k}"], g[f"b{k}"] = _norm_back(dh, n1)
            dx = dx + back
        np.add.at(g["E"], inputs, dx)
        g["P"][self.longest - inputs.shape[1] :] += dx.sum(0)
        g["E"][0] = 0
        return value, g

    def fit(self, rows: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH, seed: int = 1) -> Model:
        """Adam over rows in a fixed order."""
        rng = np.random.default_rng(seed)
        m, v = ({name: np.zeros_like(w) for name, w in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), batch):
                own = rows[order[i : i + batch]]
                own = own[:, (own > 0).any(0).argmax() :]
                if own.shape[1] < 2:
                    continue
                step += 1
                for name, d in self.loss(own)[1].items():
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.99 * v[name] + 0.01 * d * d
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def next_scores(self, rows: np.ndarray) -> np.ndarray:
        """Log shares of every track as the next one of each row; the filler has none."""
        scores = self.forward(rows)[0][:, -1] @ self.p["E"].T
        scores[:, 0] = -np.inf
        top = scores.max(1, keepdims=True)
        return scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))


def padded(sequences: list[list[int]], longest: int) -> np.ndarray:
    out = np.zeros((len(sequences), longest), np.int64)
    for row, s in zip(out, sequences, strict=True):
        own = s[-longest:]
        row[longest - len(own) :] = own
    return out


def played(events: DataFrame) -> DataFrame:
    """user_id, ts, id, track_id of what was played; a track twice in a row counts once."""
    return sessions.without_repeats(events.filter(PLAYED).filter(F.col("track_id").isNotNull()).select("user_id", "track_id", "ts", "id"))


def last_tracks(plays: DataFrame, keys: list[str], most: int = LONGEST) -> DataFrame:
    """keys, tracks: the last `most` tracks of each group, in order."""
    recent = plays.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("_n") <= most)
    listed = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "track_id"))).alias("x"))
    return listed.select(*keys, F.col("x.track_id").alias("tracks"))


@dataclass
class Trained:
    model: Model
    tracks: list[str]

    def numbers(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tracks, 1)}


def train(plays: DataFrame, gap_s: int = 21600, sample: int = SAMPLE, tracks: int = TRACKS, **options) -> Trained | None:
    """Weights from at most `sample` sessions, chosen by a hash, of two tracks or more; None where there is none."""
    epochs = options.pop("epochs", EPOCHS)
    own = last_tracks(sessions.split(plays, gap_s), ["user_id", "session_no"], options.get("longest", LONGEST) + 1).filter("size(tracks) >= 2")
    some = [r.tracks for r in own.orderBy(F.xxhash64("user_id", "session_no"), "user_id", "session_no").limit(sample).collect()]
    if not some:
        return None
    names, counts = np.unique([t for s in some for t in s], return_counts=True)
    kept = sorted(names[np.lexsort((names, -counts))[:tracks]].tolist())
    number = {t: i for i, t in enumerate(kept, 1)}
    model = Model(len(kept), **options)
    rows = padded([[number[t] for t in s if t in number] for s in some], model.longest + 1)
    return Trained(model.fit(rows, epochs), kept)


def predict(trained: Trained, plays: DataFrame, k: int = 10) -> DataFrame:
    """user_id, track_id, rank, score: the k likeliest next tracks of every user of whom a known track is among the last."""
    model, names, number = trained.model, np.array(trained.tracks, object), trained.numbers()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                b = whole.slice(a, BATCH)
                known = [[number[t] for t in s if t in number] for s in b.column(1).to_pylist()]
                users = [u for u, s in zip(b.column(0).to_pylist(), known, strict=True) if s]
                if not users:
                    continue
                scores = model.next_scores(padded([s for s in known if s], model.longest))[:, 1:]
                order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(users, object), n)), pa.array(names[order.ravel()]), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(users))), pa.array(np.take_along_axis(scores, order, 1).ravel())], ["user_id", "track_id", "rank", "score"])

    return last_tracks(plays, ["user_id"], model.longest).mapInArrow(score, "user_id string, track_id string, rank int, score double")


def held_out(plays: DataFrame, k: int = 10, **options) -> DataFrame:
    """users, hits, popular_hits: whose last track is among k predicted from all before, and among the k most played ones."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id")))
    marked = plays.withColumn("_b", back)
    before, last = marked.filter("_b > 1").drop("_b"), marked.filter("_b = 1").select("user_id", "track_id")
    trained = train(before, **options)
    shown = predict(trained, before, k).select("user_id", "track_id")
    popular = F.broadcast(before.groupBy("track_id").count().orderBy(F.desc("count"), "track_id").limit(k).select("track_id", F.lit(1).alias("popular")))
    judged = last.join(before.select("user_id").distinct(), "user_id", "left_semi").join(shown.withColumn("hit", F.lit(1)), ["user_id", "track_id"], "left").join(popular, "track_id", "left")
    return judged.agg(F.count(F.lit(1)).alias("users"), F.count("hit").alias("hits"), F.count("popular").alias("popular_hits"))
