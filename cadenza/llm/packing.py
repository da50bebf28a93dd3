"""Best-fit packing of tokenised documents, with lower bounds that certify bin counts.

Pieces are dealt at random into groups of about GROUP pieces. Each group is
packed by best-fit decreasing, and dual feasible functions give a lower bound of
its bins. Full bins stay; the documents of bins with room left, from groups with
a gap between bins and bound and from the last bins of all others, are exchanged
(dealt anew) and packed again, for as long as that saves bins.

Defined cases: a null or empty text is its end token alone; repeated rows are
documents of their own; equal lengths are placed in the order of their row
numbers; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import picked, written
from .tokens import default_path, tokenizer

CAPACITY, END = 4096, 1
#: Pieces that one task packs.
GROUP = 100_000
#: A bin with at most this much room left is not opened again.
SLACK = 16
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenise(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most capacity ids of each document, its end token included; ids are little-endian unsigned 32-bit."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step, tokens = np.array([END], "<u4").tobytes(), 4 * capacity, tokenizer(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 400):
                part = batch.slice(k, 400)
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), tokens.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    raw += end
                    for p, i in enumerate(range(0, len(raw), step)):
                        own = raw[i : i + step]
                        rows.append((doc, p, i // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return picked(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item by best-fit decreasing, and the room left in each bin."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r is open
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = room[b] = r - n
        if left:
            open_bins[left].append(b)
            some |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of dual feasible functions: thresholds, and roundings of them to multiples of 1/k."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)
    x = np.arange(capacity + 1).astype(object)
    half = capacity // 2
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    weight = np.concatenate([np.cumsum((count * x)[::-1])[::-1], [0]])
    best = -(-int(weight[0]) // capacity)
    for eps in range(1, half + 1):
        big = int(above[capacity - eps + 1])
        best = max(best, big - (-(int(weight[eps]) - int(weight[capacity - eps + 1])) // capacity))
    for k in range(1, 21):  # u(x) = x where x (k + 1) is whole, else floor(x (k + 1)) / k, in units of 1 / (k capacity)
        scaled = [v * k if v * (k + 1) % capacity == 0 else v * (k + 1) // capacity * capacity for v in range(capacity + 1)]
        best = max(best, -(-sum(int(c) * s for c, s in zip(count, scaled, strict=True)) // (k * capacity)))
    return best


def _pack(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["uid"], kind="stable")
    lengths = group["length"].to_numpy()
    bins, offsets, room = best_fit(lengths, capacity)
    gap = len(room) - lower_bound(lengths, capacity)
    return pd.DataFrame({"uid": group["uid"], "length": lengths, "part": group["part"], "bin": bins, "offset": offsets, "room": room[bins], "gap": gap})


def _packed(pieces: DataFrame, capacity: int, name: str) -> DataFrame:
    """pieces: uid, length, part."""
    kind = "uid long, length long, part long, bin long, offset long, room long, gap long"
    return written(pieces.select("uid", "length", "part").groupBy("part").applyInPandas(lambda g: _pack(g, capacity), kind), name)


def _bins(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def assign(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """uid, sequence_id, offset for pieces of columns uid (distinct) and length."""

    def dealt(df: DataFrame, n: int, seed: int, base: int) -> DataFrame:
        groups = max(1, -(-n // group))
        return df.select("uid", "length", (F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)) + base).alias("part"))

    n = pieces.count()
    done = _packed(dealt(pieces, n, 0, 0), capacity, "packed-0")
    base = max(1, -(-n // group))
    for k in itertools.count(1):  # each round saves a bin or is the last
        again = done.filter((F.col("room") > SLACK) & ((F.col("gap") > 0) | (F.col("room") > capacity // 8)))
        moved = again.count()
        if not moved or again.select("part", "bin").distinct().limit(2).count() < 2:
            break
        new = _packed(dealt(again, moved, k, base), capacity, f"packed-{k}")
        if _bins(new) >= _bins(again):
            break
        base += max(1, -(-moved // group))
        done = done.filter(~((F.col("room") > SLACK) & ((F.col("gap") > 0) | (F.col("room") > capacity // 8)))).unionByName(new)
    return done.select("uid", (F.col("part") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group: int = GROUP, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece with its sequence and its offset there; ids too if with_ids."""
    pieces = written(tokenise(docs, capacity, path, id_col, text_col, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = assign(pieces.select("uid", "length"), capacity, group)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return pieces.join(placed, "uid").select(columns)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pack(with_ids=True)."""

    def glue(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sequence_id": g["sequence_id"].iloc[:1], "ids": [np.frombuffer(b"".join(g.sort_values("offset")["ids"]), "<u4").astype(np.int64)]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(glue, "sequence_id long, ids array<long>")
