"""Removal of byte strings that repeat: suffix arrays over the shards where copies can meet.

Every string of LENGTH bytes has a key, the least hash of the GRAM-byte grams in
it. Consecutive strings of one key form a segment; equal strings have equal keys,
so they meet where segments are dealt by key. Segments that a task sees again are
settled there; of equal segments only the first goes on, so a passage of a third
of all documents is a few rows. Where several different segments share a key,
their bytes form shards: a suffix array by prefix doubling with refinement of
unsorted groups only (Larsson and Sadakane), common prefixes in text order
(Kasai's rule, by its irreducible values), and groups of suffixes that share
LENGTH bytes. A key too large for a shard is cut into several, and each shard's
strings are searched in the sorted strings of those before it. The rows of a key
beyond KEY_BYTES (a line that starts a third of all documents) are dealt to shards
of their own, each sorted by a task of its own; what each shard found first is
merged across shards by a shuffle of 128-bit string hashes.

Segments are equal if their keys and 64-bit content hashes, 128 bits together, are.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; rows
of the same id are ordered by a hash of their text; rows that repeat id and text
are one document, returned each; a null id comes before all others; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import U64, Powers, chunks, longs, mix, picked, text_buffer, written

LENGTH, GRAM = 100, 32
#: Bytes of a shard.
SHARD_BYTES = 1 << 20
#: Bytes of a key that one task holds, and the most keys beyond it (their list is broadcast).
KEY_BYTES, LARGE_KEYS = 8 << 20, 100_000
_BYTES, _OTHER = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_SYMBOLS = 7
_NULL_ID = -(1 << 63)


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """best over each window of width items."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Key, content hash, document, start and number of strings of each segment, and whether strings inside it may be equal."""
    none = (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    if len(data) < length:
        return none
    up, down = _BYTES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    width = length - gram + 1
    low = _sliding(np.minimum, grams, width)
    size = np.diff(offsets)
    fits = np.flatnonzero(size >= length)
    if not len(fits):
        return none
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[:-1][fits] + size[fits] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[offsets[:-1][fits]] = True
    new &= inside
    start = np.flatnonzero(new)
    stop = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    end_of_doc = offsets[doc + 1] - length + 1
    following = np.r_[start[1:], stop[-1]]
    n = np.minimum(following, end_of_doc) - start
    content = mix((sums[start + n + length - 1] - sums[start]) * down[start] + n.astype(U64))
    edge = np.zeros(width - 1, U64)
    least = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, low, edge]), width) == grams)
    twice = (np.diff(least) < width) & (grams[least[1:]] == grams[least[:-1]])
    inner = np.isin(low[start], grams[least[1:][twice]]) | (n > width)
    return low[start], content, doc, start - offsets[doc], n, inner


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of the pieces text[..:ends[0]], ..; each ends with its piece. Also the seven-symbol keys."""
    n = len(text)
    left = (np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)).astype(np.int32)
    symbol = np.zeros(n + _SYMBOLS, U64)
    symbol[:n] = text.astype(U64) + U64(1)
    key = np.zeros(n, U64)
    for i in range(_SYMBOLS):
        key = (key << U64(9)) | np.where(left > i, symbol[i : n + i], U64(0))
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = place
    h = _SYMBOLS
    longest = int(left.max(initial=0))
    single = head & np.r_[head[1:], True]
    at = np.flatnonzero(~single)
    while h < longest and len(at):
        own = order[at]
        more = left[own] > h
        beyond = np.where(more, rank[np.where(more, own + h, 0)] + 1, 0)
        both = (place[at].astype(U64) << U64(32)) | beyond.astype(U64)
        by = np.argsort(both, kind="stable")
        order[at], both = own[by], both[by]
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        place[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[order[at]] = place[at]
        alone = new & np.r_[new[1:], True]
        at = at[~alone]
        h *= 2
    return order, key


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The length that each suffix, in sorted order, shares with the one before it.

    In text order a value is the last one less 1 where both suffixes continue
    the same symbol; only the others, the irreducible, are compared.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    starts = np.r_[0, ends[:-1]]
    first = np.zeros(n, bool)
    first[starts[starts < n]] = True
    p = np.arange(n)
    reducible = (before > 0) & ~first & ~first[np.maximum(before, 0)]
    reducible[reducible] = text[p[reducible] - 1] == text[before[reducible] - 1]
    at = np.flatnonzero(~reducible & (before >= 0))
    shared = np.zeros(n, np.int64)
    active, other, last = at, before[at], np.zeros(len(at), np.int64)
    while len(active):
        a, b = key[active + last], key[other + last]
        same = np.zeros(len(active), np.int64)
        still = np.ones(len(active), bool)
        for i in range(_SYMBOLS - 1, -1, -1):
            x = (a >> U64(9 * i)) & U64(511)
            still &= (x == (b >> U64(9 * i)) & U64(511)) & (x > 0)
            same += still
        last = last + same
        shared[active] = last
        on = (same == _SYMBOLS) & (active + last < n) & (other + last < n)
        on[on] = ~first[(active + last)[on]] & ~first[(other + last)[on]]
        active, other, last = active[on], other[on], last[on]
    source = np.maximum.accumulate(np.where(reducible, 0, p))
    return (shared[source] + source - p)[order]


class Shard:
    """The strings of a set of segments, in sorted order and grouped where equal."""

    def __init__(self, parts: list[bytes], counts: np.ndarray, length: int) -> None:
        self.length = length
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        self.ends = np.cumsum([len(x) for x in parts])
        order, key = suffix_array(self.text, self.ends)
        shared = common_prefixes(self.text, self.ends, order, key)
        left = np.repeat(self.ends, np.diff(np.r_[0, self.ends])) - np.arange(len(self.text))
        whole = left[order] >= length
        group = np.cumsum(shared < length)[whole]
        self.order = order[whole]
        heads = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(group) else np.zeros(0, int)
        self.size = np.diff(np.r_[heads, len(group)])
        self.first = np.minimum.reduceat(self.order, heads) if len(heads) else np.zeros(0, int)
        self.again = np.ones(len(self.text), bool)
        self.again[self.first] = False
        self.again[order[~whole]] = False
        self.heads = heads

    def _words(self, at: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(len(at), U64)
        for b in range(8):
            out <<= U64(8)
            if 8 * i + b < self.length:
                out |= self.text[at + 8 * i + b].astype(U64)
        return out

    def _less(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether my string sorts before the other's, and whether they are equal."""
        less, equal = np.zeros(len(mine), bool), np.ones(len(mine), bool)
        for i in range(-(-self.length // 8)):
            at = np.flatnonzero(equal)
            if not len(at):
                break
            a, b = self._words(mine[at], i), other._words(theirs[at], i)
            less[at], equal[at] = a < b, a == b
        return less, equal

    def drop_known(self, earlier: Shard) -> None:
        """Marks the strings that an earlier shard has too, by binary search of its sorted strings."""
        if not len(earlier.first) or not len(self.first):
            return
        low, high = np.zeros(len(self.first), np.int64), np.full(len(self.first), len(earlier.first))
        while (low < high).any():
            middle = (low + high) // 2
            at = np.minimum(middle, len(earlier.first) - 1)
            less, _ = earlier._less(earlier.first[at], self, self.first)
            move = low < high
            low, high = np.where(move & less, middle + 1, low), np.where(move & ~less, middle, high)
        found = low < len(earlier.first)
        _, equal = earlier._less(earlier.first[np.minimum(low, len(earlier.first) - 1)], self, self.first)
        self.again[self.first[found & equal]] = True


    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each first string."""
        out = []
        for powers in (_BYTES, _OTHER):
            up, down = powers.upto(len(self.text) + 1)
            sums = np.zeros(len(self.text) + 1, U64)
            np.cumsum((self.text.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
            out.append(mix((sums[self.first + self.length] - sums[self.first]) * down[self.first]).view(np.int64))
        return out[0], out[1]

    def spans(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of marked strings: segment, start in its document, number."""
        piece_start = np.r_[0, self.ends[:-1]]
        edge = np.zeros(len(self.again), bool)
        edge[piece_start[piece_start < len(self.again)]] = True
        begin = np.flatnonzero(self.again & (edge | ~np.r_[False, self.again[:-1]]))
        stop = np.flatnonzero(self.again & np.r_[edge[1:] | ~self.again[1:], True]) + 1
        piece = np.searchsorted(self.ends, begin, "right")
        return piece, begin - piece_start[piece] + starts[piece], stop - begin


def shard_spans(keys: list, parts: list[bytes], starts: list[int], counts: list[int], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Strings that occur earlier: segment, start in its document and number of each run. Segments come by key and place."""
    shards: list[tuple[int, int]] = []
    i, size = 0, 0
    for j in range(len(parts)):
        if size and size + len(parts[j]) > shard_bytes:
            shards.append((i, j))
            i, size = j, 0
        size += len(parts[j])
    shards.append((i, len(parts)))
    found: tuple[list, list, list] = ([], [], [])
    open_shards: list[tuple[object, Shard]] = []
    for i, j in shards:
        shard = Shard(parts[i:j], np.array(counts[i:j]), length)
        open_shards = [(k, s) for k, s in open_shards if k == keys[i]]
        for _, earlier in open_shards:
            shard.drop_known(earlier)
        open_shards.append((keys[j - 1], shard))
        piece, begin, n = shard.spans(np.array(starts[i:j]))
        found[0].extend((piece + i).tolist())
        found[1].append(begin)
        found[2].append(n)
    return found[0], np.concatenate(found[1]), np.concatenate(found[2])


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by string hashes (the first two columns) and place, all but the first of each string; without the hashes."""
    last: tuple | None = None
    for b in batches:
        if b.num_rows:
            x, y = np.asarray(b.column(0)), np.asarray(b.column(1))
            again = np.r_[last == (x[0], y[0]), (x[1:] == x[:-1]) & (y[1:] == y[:-1])]
            last = (x[-1], y[-1])
            yield pa.RecordBatch.from_arrays(b.columns[2:], b.schema.names[2:]).filter(pa.array(again))


def _pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 31 | n.astype(np.int64)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are equal in all columns."""
    new = np.logical_or.reduce([np.r_[True, x[1:] != x[:-1]] for x in columns])
    cuts = [*np.flatnonzero(new).tolist(), len(new)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


#: Set in a packed place where strings inside the segment may be equal.
_INNER = 1 << 62


def repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, text and places, the packed (start, number) runs of strings that also start earlier."""
    base = picked(docs, id_col, text_col).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    distinct = base.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0
    ids = ["d"] if distinct else ["d", "k"]
    if not distinct:
        base = base.select("d", F.xxhash64("text").alias("k"), "text")
    n_ids, id_kind = len(ids), ", ".join(f"{c} long" for c in ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [longs(batch.column(c)) for c in range(n_ids)]
            offsets, data = text_buffer(batch.column(n_ids))
            held = []
            for i, j in chunks(offsets, 1 << 20):
                key, content, doc, start, n, inner = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                held.append((key.view(np.int64), content.view(np.int64), *(r[doc + i] for r in rows), _pack(start, n) | inner.astype(np.int64) * _INNER))
            if not held:
                continue
            all_of = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort(all_of[::-1])
            key, content, *place = (x[order] for x in all_of)
            same = np.r_[False, (np.diff(key) == 0) & (np.diff(content) == 0)] if len(key) else np.zeros(0, bool)
            row_again = same & np.r_[False, np.logical_and.reduce([np.diff(p) == 0 for p in place])] if len(key) else same
            again = same & ~row_again
            place[-1] = np.where(again, -place[-1] - 1, place[-1])
            spread = mix(place[-1].view(U64) ^ place[0].view(U64)).view(np.int64)
            key = np.where(again, spread, key)
            keep = ~row_again
            arrays = [key, content, *place]
            for a in range(0, int(keep.sum()), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[keep][a : a + 100_000]) for x in arrays], ["v", "content", *ids, "place"])

    cut_up = base.select(*ids, "text").mapInArrow(cut, f"v long, content long, {id_kind}, place long")
    order = ["v", "content", *ids, "place"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by key, content and place. v stays only on first segments that have others of their key to be compared with."""
        tail: list[np.ndarray] | None = None
        was: tuple | None = None

        def settle(x: list[np.ndarray], following: int | None) -> pa.RecordBatch:
            nonlocal was
            v, content = x[0], x[1]
            sure = x[-1] < 0
            prior_v, prior_c, prior_ids = was if was else (None, None, None)
            same_key = np.r_[prior_v is not None and v[0] == prior_v, v[1:] == v[:-1]]
            same = same_key & np.r_[prior_c is not None and content[0] == prior_c, content[1:] == content[:-1]]
            next_key = np.r_[same_key[1:], following is not None and v[-1] == following]
            twin = same & np.r_[prior_ids is not None and all(a[0] == b for a, b in zip(x[2:], prior_ids, strict=True)), np.logical_and.reduce([a[1:] == a[:-1] for a in x[2:]])]
            check = ~same & (same_key | next_key | (x[-1] & _INNER != 0)) & ~sure
            gone = (same & ~twin) | sure
            was = (v[-1], content[-1], [a[-1] for a in x[2:]])
            out = gone | check
            place = np.where(sure, -x[-1] - 1, x[-1]) & ~_INNER
            return pa.RecordBatch.from_arrays([pa.array(v[out], mask=gone[out]), *(pa.array(a[out]) for a in x[2:-1]), pa.array(place[out])], ["v", *ids, "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = [np.asarray(c) for c in batch.columns]
            if tail is not None:
                yield settle(tail, int(x[0][0]))
            tail = x
        if tail is not None:
            yield settle(tail, None)

    dealt = cut_up.repartition("v").sortWithinPartitions(*order)
    met = written(dealt.mapInArrow(meet, f"v long, {id_kind}, place long"), "segments")
    compare = met.filter("v is not null")
    size = F.col("place").bitwiseAND(F.lit((1 << 31) - 1)) + (length - 1)
    bound = max(KEY_BYTES, -(-(compare.agg(F.sum(size)).first()[0] or 0) // LARGE_KEYS))
    large = compare.groupBy("v").agg(F.sum(size).alias("size")).filter(F.col("size") > bound).select("v", F.ceil(F.col("size") / SHARD_BYTES).alias("shards"))
    shard = F.coalesce(F.pmod(F.xxhash64(*ids, "place"), F.col("shards")).cast("int"), F.lit(-1)).alias("shard")
    compare = compare.join(F.broadcast(large), "v", "left").select("v", *ids, "place", shard)
    asked = compare.groupBy(*ids).agg(F.collect_list(F.struct("v", "place", "shard")).alias("wanted"))
    with_text = base.dropDuplicates(ids) if not distinct else base
    sides = with_text.join(asked, ids)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(n_ids))
            wanted = batch.column(n_ids + 1)
            for a in range(0, batch.num_rows, 200):
                part = wanted.slice(a, 200)
                which = np.repeat(np.arange(a, a + len(part)), np.asarray(pc.list_value_length(part)))
                flat = part.flatten()
                v, place = np.asarray(flat.field("v")), np.asarray(flat.field("place"))
                start, n = place >> 31, place & ((1 << 31) - 1)
                begin = offsets[which] + start
                texts = [data[x : x + m].tobytes() for x, m in zip(begin.tolist(), (n + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v), flat.field("shard"), *(batch.column(c).take(pa.array(which)) for c in range(n_ids)), pa.array(place), pa.array(texts, pa.binary())], ["v", "shard", *ids, "place", "bytes"])

    taken = sides.select(*ids, "text", "wanted").mapInArrow(take, f"v long, shard int, {id_kind}, place long, bytes binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole keys until a shard is full; a key that goes on stays together, unless its rows are dealt to shards."""
        held: list[pa.RecordBatch] = []
        size = 0

        def result(rows: pa.Table, which: np.ndarray, start: np.ndarray, n: np.ndarray, hashes: tuple | None = None) -> pa.RecordBatch:
            own = pa.array(which)
            first, second = (pa.array(h) for h in hashes) if hashes else (pa.nulls(len(which), pa.int64()),) * 2
            return pa.RecordBatch.from_arrays([first, second, *(rows.column(c).combine_chunks().take(own) for c in ids), pa.array(_pack(start, n))], ["first", "second", *ids, "place"])

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            place, dealt = np.asarray(rows.column("place").combine_chunks()), np.asarray(rows.column("shard").combine_chunks())
            v, start, n = np.asarray(rows.column("v").combine_chunks()), place >> 31, place & ((1 << 31) - 1)
            for low, high in _runs(np.where(dealt < 0, np.int64(0), v), dealt):
                part = rows.slice(low, high - low)
                texts = part.column("bytes").to_pylist()
                if dealt[low] < 0:
                    yield result(part, *(np.asarray(x, np.int64) for x in shard_spans(v[low:high].tolist(), texts, start[low:high].tolist(), n[low:high].tolist(), length)))
                    continue
                shard = Shard(texts, n[low:high], length)
                yield result(part, *shard.spans(start[low:high]))
                piece = np.searchsorted(shard.ends, shard.first, "right")
                begin = shard.first - np.r_[0, shard.ends[:-1]][piece] + start[low:high][piece]
                yield result(part, piece, begin, np.ones(len(piece), np.int64), shard.fingerprints())

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= 2 * SHARD_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks()
                v, dealt = np.asarray(rows.column("v").chunk(0)), np.asarray(rows.column("shard").chunk(0))
                last = int(np.argmax((v == v[-1]) & (dealt == dealt[-1])))
                if last:
                    yield from out(rows.slice(0, last))
                    held = rows.slice(last).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from out(pa.Table.from_batches(held))

    sorted_rows = taken.repartition("v", "shard").sortWithinPartitions("v", "shard", *ids, "place")
    compared = written(sorted_rows.mapInArrow(sort, f"first long, second long, {id_kind}, place long"), "compared")
    firsts = compared.filter("first is not null").repartition("first", "second").sortWithinPartitions("first", "second", *ids, "place")
    merged = compared.filter("first is null").select(*ids, "place").unionByName(firsts.mapInArrow(_unseen, f"{id_kind}, place long"))
    gone = met.filter("v is null").select(*ids, "place").unionByName(merged).groupBy(*ids).agg(F.collect_list("place").alias("places"))
    return base.join(gone, ids, "left").select(F.when(F.col("d") != _NULL_ID, F.col("d")).alias(id_col), F.col("text").alias(text_col), "places")


def covered(size: int, places: list[int] | None, length: int) -> np.ndarray:
    """Maximal runs (start, end) of the bytes that the strings cover."""
    if places is None or not len(places):
        return np.zeros((0, 2), np.int64)
    p = np.asarray(places)
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, p >> 31, 1)
    np.add.at(change, (p >> 31) + (p & ((1 << 31) - 1)) + length - 1, -1)
    inside = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.r_[0, inside.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, removed (array of start, end), kept (the remaining bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                offsets, data = text_buffer(part.column(1))
                runs, kept = [], []
                for k, places in enumerate(part.column(2)):
                    own = data[offsets[k] : offsets[k + 1]]
                    spans = covered(len(own), np.asarray(places.values) if places.is_valid else None, length)
                    runs.append([{"start": int(x), "end": int(y)} for x, y in spans])
                    cuts = np.r_[0, spans.reshape(-1), len(own)].reshape(-1, 2)
                    kept.append(b"".join(own[x:y].tobytes() for x, y in cuts))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(runs, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    found = repeated(docs, length, id_col, text_col)
    return found.mapInArrow(run, "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return result.select(id_col, "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
