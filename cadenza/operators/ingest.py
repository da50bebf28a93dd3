"""Ingest of events: validation, noise, duplicates, upserts; snapshots and retention of derived tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources import shared

PAST_S, FUTURE_S = 86400, 300
DUPLICATE_S = 2


def valid(now: int, past_s: int = PAST_S, future_s: int = FUTURE_S) -> Column:
    """Whether an event's time, value and ranges are acceptable; what is missing is."""
    within = lambda c, low, high: F.col(c).isNull() | F.col(c).between(low, high)
    return F.col("ts").between(now - past_s, now + future_s) & within("value", -1, 100000) & within("hour_of_day", 0, 23)


def noise() -> Column:
    """A play that ended at once."""
    return (F.col("event_type") == "play_end") & (F.coalesce("value", F.lit(1.0)) < 0.05)


KEYS = ("user_id", "track_id", "event_type")


class _Range:
    """A sorted range of events: where keys begin, and for each event the first of its key that lies beyond its window."""

    def __init__(self, rows: pa.Table, window_s: int) -> None:
        self.ts, self.window_s = np.asarray(rows.column("ts").combine_chunks()).astype(np.int64), window_s
        n = len(self.ts)
        change = np.zeros(n, bool)
        change[:1] = True
        for k in KEYS:
            codes = np.asarray(rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1))
            change[1:] |= codes[1:] != codes[:-1]
        self.group = np.cumsum(change) - 1
        self.begins = np.flatnonzero(change)
        low = self.ts.min() if n else 0
        place = self.group * (int(self.ts.max() if n else 0) - low + window_s + 1) + self.ts - low
        self.next = np.searchsorted(place, place + window_s, "right")
        self.first_end = int(self.begins[1]) if len(self.begins) > 1 else n

    def accepted(self, begins: np.ndarray) -> np.ndarray:
        """The events on the chains that start at begins, each of a key of its own."""
        out, at = np.zeros(len(self.ts), bool), begins
        while len(at):
            out[at] = True
            after = self.next[at]
            inside = after < len(self.ts)
            at = after[inside][self.group[after[inside]] == self.group[at[inside]]]
        return out

    def exits(self) -> tuple[list[int], list[int]]:
        """Times within the window of the first event of the first key, and the next one; and the last accepted time of that key if its chain starts there."""
        end = self.first_end
        step = np.minimum(self.next[:end], end)
        hop = np.where(step < end, step, np.arange(end))
        while True:
            far = hop[hop]
            if (far == hop).all():
                break
            hop = far
        last = self.ts[hop]
        own = np.flatnonzero(np.r_[True, np.diff(self.ts[:end]) > 0])
        own = own[: int(np.searchsorted(self.ts[own], self.ts[0] + self.window_s, "right")) + 1]
        return self.ts[own].tolist(), last[own].tolist()


def accepted_times(events: DataFrame, window_s: int = DUPLICATE_S) -> DataFrame:
    """events with accepted: no accepted event of the same user, track and type stands within window_s before it.

    Events are sorted in ranges of key and time, so that a key of very many events, even
    one run of close ones, is the work of many tasks. Each range takes its events as if
    nothing of their key came before, and tells what the last accepted time of its first key
    would be for each place where its chain can start: at most window_s + 1 different
    seconds. These are composed over the ranges in order; where a chain does start later
    than was assumed, the first key of that range is walked again.
    """
    names = [f.name for f in events.schema.fields]
    order = [*KEYS, "ts", "id"]
    marks = "accepted boolean, _part int, _first boolean, _times array<long>, _lasts array<long>, _first_key array<string>, _last_key array<string>, _last long"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", " + marks

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        r = _Range(rows, window_s)
        fine, n = r.accepted(r.begins), len(r.ts)
        times, lasts = r.exits()
        own = np.flatnonzero(fine[r.begins[-1] :])[-1] + r.begins[-1]
        key = lambda i: [rows.column(k)[i].as_py() for k in KEYS]
        one = lambda x, kind: pa.array([x, *[None] * (n - 1)], kind)
        columns = [pa.array(fine), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n) < r.first_end), one(times, pa.list_(pa.int64())), one(lasts, pa.list_(pa.int64())), one(key(0), pa.list_(pa.string())), one(key(n - 1), pa.list_(pa.string())), one(int(r.ts[own]), pa.int64())]
        for c, name in zip(columns, ("accepted", "_part", "_first", "_times", "_lasts", "_first_key", "_last_key", "_last"), strict=True):
            rows = rows.append_column(name, c)
        yield from rows.combine_chunks().to_batches()

    ranges = shared.stored(events.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(taken, schema), "accepted-ranges")
    late: list[tuple[int, int]] = []
    key, last = None, None
    for r in ranges.filter("_times IS NOT NULL").select("_part", "_times", "_lasts", "_first_key", "_last_key", "_last").orderBy("_part").collect():  # a row for each range
        same = key is not None and list(r._first_key) == key
        if same and r._times[0] - last <= window_s:
            late.append((r._part, last))
            beyond = [x for t, x in zip(r._times, r._lasts, strict=True) if t > last + window_s]
            if list(r._last_key) != list(r._first_key):
                last = r._last
            elif beyond:
                last = beyond[0]
        else:
            last = r._last
        key = list(r._last_key)
    plain = ranges.select(*names, "accepted", "_part", "_first")
    if not late:
        return plain.select(*names, "accepted")
    before = events.sparkSession.createDataFrame(late, "_part int, _before long")
    wrong = plain.filter("_first").join(F.broadcast(before), "_part").repartition("_part").sortWithinPartitions("_part", *order)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        parts = np.asarray(rows.column("_part").combine_chunks())
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = rows.slice(a, z - a)
            r = _Range(own, window_s)
            start = int(np.searchsorted(r.ts, own.column("_before")[0].as_py() + window_s, "right"))
            fine = r.accepted(np.array([start] if start < len(r.ts) else [], np.int64))
            yield from own.select(names).append_column("accepted", pa.array(fine)).combine_chunks().to_batches()

    kept = plain.join(F.broadcast(before.select("_part")), "_part", "left_anti").unionByName(plain.filter("NOT _first").join(F.broadcast(before.select("_part")), "_part", "left_semi"))
    fixed = wrong.select(*names, "_part", "_before").mapInArrow(again, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", accepted boolean")
    return kept.select(*names, "accepted").unionByName(fixed)


def judged(events: DataFrame, now: int, past_s: int = PAST_S, window_s: int = DUPLICATE_S) -> DataFrame:
    """events with status: rejected, noise, duplicate or accepted."""
    checked = events.withColumn("status", F.when(~valid(now, past_s), "rejected").when(noise(), "noise"))
    fine = accepted_times(checked.filter("status IS NULL").drop("status"), window_s)
    fine = fine.withColumn("status", F.when(F.col("accepted"), "accepted").otherwise("duplicate")).drop("accepted")
    return checked.filter("status IS NOT NULL").unionByName(fine)


def newest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The upsert of new into old: of rows with equal keys that of the highest version; new wins a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))))
    return best.filter("_n = 1").drop("_n", "_new")


def only_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and those rows of new whose keys it lacks (an idempotent append)."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """old with all rows of new's scopes replaced by new's rows."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def remapped(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """df with ids of column replaced where mapping (old, new) has them."""
    return df.join(F.broadcast(mapping), df[column] == mapping["old"], "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def eligible(now: int, most: int) -> Column:
    """Whether a task may be tried again."""
    return F.col("state").isin("pending", "failed") & (F.col("attempts") < most) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
