"""Helpers shared by the corpus operators: tables, shared folders, bytes and hashes.

Texts are handled inside tasks as one UTF-8 byte buffer with offsets, as Arrow
delivers them, so that numpy can scan many documents at once. Batches are cut
into chunks of whole documents so that memory follows the chunk, not the batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(docs: DataFrame, name: str) -> int:
    """The place of a column by its exact name, else by its name in any case."""
    names = docs.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def picked(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever other columns are called."""
    renamed = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return renamed.select(*[F.col(f"_{position(docs, n)}").alias(n) for n in names])


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """work on rows whose columns are doc_id, text and numbers, and that returns these columns; then under their names again."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    names[position(docs, id_col)], names[position(docs, text_col)] = "doc_id", "text"
    return work(docs.toDF(*names)).toDF(*docs.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and Spark is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        root = context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cadenza-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The most keys that split_join broadcasts.
HOT_KEYS = 1000


def split_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left join right on key, where right has a row for a key and n, the number of left's rows of it; total is that of all.

    Keys of more than a HOT_KEYS-th of all rows, which are at most HOT_KEYS, are
    broadcast, so that the rows of such a key stay where they are; all others are shuffled.
    """
    bound = max(HOT_KEYS, -(-total // HOT_KEYS))
    hot = right.filter(F.col("n") > bound)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col("n") <= bound), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about limit bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def longs(column: pa.Array) -> np.ndarray:
    """An integer column as int64; nulls (see nulls()) are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pc.fill_null(column.cast(pa.int64()), 0))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(size, b, U64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end], whatever its place."""
    up, down = _BYTES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def run_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive item hashes."""
    if len(items) < n:
        return np.zeros(0, U64)
    up, down = _WORDS.upto(len(items) + 1)
    sums = np.zeros(len(items) + 1, U64)
    np.cumsum(items * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(items) - n + 1] + U64(n))


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing: 0-9, a-z and all bytes of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of True, which never cross documents."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, then starts, ends and documents of all words."""
    low = LOWER[data]
    return low, *spans(IN_WORD[low], offsets)
