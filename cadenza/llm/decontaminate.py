"""Benchmark decontamination: windows of normalised words that a test set shares with documents.

The hash set of the benchmark's word windows is broadcast once its size is
known to be within a bound; documents are scanned once, without a shuffle.
Beyond the bound windows meet by a shuffled join on their hash. Either way each
hit is verified against the window's words before it counts.

Defined cases: a null or wordless text has no words and is never contaminated;
an item of fewer words than a window is one window; the words of an item without
an id are hit, and it is not listed; rows that repeat (the same
id or the same text) are judged each on its own; an empty benchmark hits
nothing; other columns of the inputs are not touched or read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, picked, run_hashes, shielded, span_hashes, text_buffer, words

WINDOW = 13
#: Most benchmark windows that are broadcast (about 150 bytes each).
BROADCAST_WINDOWS = 400_000
_FILTER_BITS = 20
_RESULT = pa.schema([("n_words", pa.int64()), ("hit_from", pa.list_(pa.int64())), ("hit_to", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, n (words in the window), hash, words (space-joined): the distinct windows of each item."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            offsets, data = text_buffer(batch.column(1))
            out: dict[tuple, None] = {}
            for i, j in chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                low, starts, ends, doc = words(data[offsets[i] : offsets[j]], own)
                raw, hashes, first = low.tobytes(), span_hashes(low, starts, ends), np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(j - i):
                    a, b = int(first[k]), int(first[k + 1])
                    n = min(window, b - a)
                    if n:
                        for at, h in enumerate(run_hashes(hashes[a:b], n).view(np.int64).tolist(), a):
                            out[items[i + k], n, h, b" ".join(raw[s:e] for s, e in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True))] = None
            if out:
                item, n, h, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(text, pa.binary())], ["item", "n", "hash", "words"])

    return picked(benchmark, id_col, text_col).select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(build, "item string, n int, hash long, words binary").distinct()


class _Windows:
    """The windows of one length, for lookup: a bit filter, then sorted hashes, then the words."""

    def __init__(self, rows: list) -> None:
        self.known: dict[int, dict[bytes, list[str]]] = {}
        for r in rows:
            self.known.setdefault(r.hash, {}).setdefault(bytes(r.words), []).append(r.item)
        self.hashes = np.sort(np.array(list(self.known), np.int64))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes & ((1 << _FILTER_BITS) - 1)] = True

    def likely(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.int64)
        at = np.flatnonzero(self.filter[h & ((1 << _FILTER_BITS) - 1)])
        found = self.hashes[np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)] == h[at]
        return at[found]


def _hits(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, hashes: np.ndarray, windows: dict[int, _Windows]) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, words, items) of each verified occurrence of a window."""
    raw = low.tobytes()
    for n, known in windows.items():
        runs = run_hashes(hashes, n)
        at = known.likely(runs)
        at = at[doc[at] == doc[at + n - 1]]
        for k in at.tolist():
            text = b" ".join(raw[s:e] for s, e in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True))
            items = known.known[int(runs[k].view(np.int64))].get(text)
            if items is not None:
                yield k, n, items


def _merged(found: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Union of word ranges (first, words), as starts and ends."""
    starts: list[int] = []
    ends: list[int] = []
    for a, n in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], a + n)
        else:
            starts.append(a)
            ends.append(a + n)
    return starts, ends


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of docs: id, text and keep columns, n_words, hit_from, hit_to (word ranges), items (sorted strings)."""
    spark = docs.sparkSession
    found = benchmark_windows(benchmark, window)
    if found.limit(broadcast_windows + 1).count() > broadcast_windows:
        return _find_hits_shuffled(docs, found, id_col, text_col, keep)
    by_length: dict[int, list] = {}
    for r in found.collect():  # within broadcast_windows
        by_length.setdefault(r.n, []).append(r)
    shared = spark.sparkContext.broadcast({n: _Windows(rows) for n, rows in sorted(by_length.items())})
    base = picked(docs, *dict.fromkeys([id_col, text_col, *keep]))
    at = base.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            offsets, data = text_buffer(batch.column(at))
            for i, j in chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                low, starts, ends, doc = words(data[offsets[i] : offsets[j]], own)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                ranges: dict[int, list] = {}
                items: dict[int, set] = {}
                for k, n, names in _hits(low, starts, ends, doc, span_hashes(low, starts, ends), windows):
                    d = int(doc[k])
                    ranges.setdefault(d, []).append((k - int(first[d]), n))
                    items.setdefault(d, set()).update(x for x in names if x is not None)
                both = [_merged(ranges[d]) if d in ranges else ([], []) for d in range(j - i)]
                made = [pa.array(np.diff(first)), pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.list_(pa.int64())), pa.array([sorted(items.get(d, ())) for d in range(j - i)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *made], [*batch.schema.names, *_RESULT.names])

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(scan, f"{fields}, n_words long, hit_from array<long>, hit_to array<long>, items array<string>")


def _find_hits_shuffled(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The same by a shuffled join on window hashes, for a benchmark too large to broadcast."""
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # at most as many as words in a window
    base = picked(docs, *dict.fromkeys([id_col, text_col, *keep])).withColumn("_row", F.sha2(F.to_json(F.struct(id_col, text_col)), 256))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                low, starts, ends, doc = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes, first, raw = span_hashes(low, starts, ends), np.searchsorted(doc, np.arange(j - i + 1)), low.tobytes()
                for n in lengths:
                    runs = run_hashes(hashes, n)
                    at = np.flatnonzero(doc[: len(runs)] == doc[n - 1 :]) if len(runs) else np.zeros(0, int)
                    for part in np.array_split(at, len(at) // 50_000 + 1):
                        texts = [raw[starts[k] : ends[k + n - 1]] for k in part.tolist()]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[part] + i)), pa.array(part - first[doc[part]]), pa.array(np.full(len(part), n, np.int32)), pa.array(runs[part].view(np.int64)), pa.array(texts, pa.binary())], ["_row", "at", "n", "hash", "raw"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(batch.schema.names.index(text_col)))
            sizes = [np.bincount(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[3], minlength=j - i) for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(sizes or [np.zeros(0, int)]).astype(np.int64))], [*batch.schema.names, "n_words"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(3))
            _, starts, ends, doc = words(data, offsets)
            raw, first = data.tobytes(), np.searchsorted(doc, np.arange(len(offsets)))
            same = [b" ".join(raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)) == w for a, b, w in zip(first[:-1].tolist(), first[1:].tolist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select([0, 1, 2, 4]).filter(pa.array(same, pa.bool_()))

    emitted = base.select("_row", F.col(text_col).cast("string")).distinct().mapInArrow(emit, "_row string, at long, n int, hash long, raw binary")
    pairs = emitted.join(windows, ["n", "hash"]).select("_row", "at", "n", F.col("raw").cast("string").alias("raw"), "item", "words")
    hits = pairs.mapInArrow(checked, "_row string, at long, n int, item string")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_merged([(x["at"], x["n"]) for x in found]) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.list_(pa.int64())), batch.column(2)], ["_row", "hit_from", "hit_to", "items"])

    per_row = hits.groupBy("_row").agg(F.collect_set(F.struct("at", "n")), F.sort_array(F.collect_set("item"))).mapInArrow(unite, "_row string, hit_from array<long>, hit_to array<long>, items array<string>")
    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    empty = F.array().cast("array<long>")
    return (
        base.mapInArrow(counted, f"{fields}, n_words long")
        .join(per_row, "_row", "left")
        .select(*[c for c in base.columns if c != "_row"], "n_words", F.coalesce("hit_from", empty).alias("hit_from"), F.coalesce("hit_to", empty).alias("hit_to"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def judge(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, items digest and verdict: contaminated where at least one in twenty words is hit."""
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with hit words cut out of every text (remove="spans")."""
    return shielded(docs, lambda d: _decontaminated(d, benchmark, window, remove), id_col, text_col)


def _decontaminated(docs: DataFrame, benchmark: DataFrame, window: int, remove: str) -> DataFrame:
    id_col, text_col, columns = "doc_id", "text", docs.columns
    hits = find_hits(docs, benchmark, window, id_col, text_col, tuple(columns))
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    if remove == "documents":
        return hits.filter(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select(columns)
    at = columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(at))
            texts = batch.column(at).to_pylist()
            for k, (a, b) in enumerate(zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)):
                if a:
                    own = data[offsets[k] : offsets[k + 1]]
                    _, starts, ends, _ = words(own, np.array([0, len(own)]))
                    raw, out, last = own.tobytes(), [], 0
                    for x, y in zip(a, b, strict=True):
                        out.append(raw[last : starts[x]])
                        last = int(ends[y - 1])
                    texts[k] = b"".join([*out, raw[last:]]).decode()
            made = [c if k != at else pa.array(texts, c.type) for k, c in enumerate(batch.columns[: len(columns)])]
            yield pa.RecordBatch.from_arrays(made, columns)

    return hits.select(*columns, "hit_from", "hit_to").mapInArrow(cut, docs.schema)


