"""Byte-level BPE of whole texts by a monoid tree: halves are encoded apart and joined.

An element is the ids of a stretch of text; the join of two neighbours keeps all
ids but those of a window around the boundary, which is encoded again and grows
until the ids outside of it are proven to stand. Two proofs are used:

- Between some characters every text is cut, whatever surrounds them: no
  alternative of the pattern runs from a character that is not white space into
  one that is, nor from a letter to a digit, or back, nor from a letter or digit
  into punctuation. A window that begins and ends at such places is encoded like
  the same stretch of the whole text, and so are both sides.
- Inside one long run of ASCII letters or of digits, which is a single match, ids
  stand if each two adjacent ones are what their own bytes encode to: any merge
  across a boundary would already happen in the pair. The window then begins and
  ends at ids inside the run, and its two outer pairs are checked.

The tree is reduced in the task that holds a text, down to stretches that the
tokenizer encodes at once; texts beyond LONG_CHARS are cut into segments that are
dealt to all tasks, encoded there and joined in their order. The join is
associative, so both give the ids of the whole text. Decoding looks up the bytes
of each id and concatenates them up the tree.

Defined cases: a null text is empty and has no ids; special tokens in a text are
ordinary text; a null id is kept; rows that repeat are rows of their own, those
with one id and one long text included; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import partitions, picked, written

#: Characters that the tokenizer encodes at once.
LEAF_CHARS = 1 << 14
#: Characters from where a text is cut into segments, and of a segment.
LONG_CHARS, SEGMENT_CHARS = 4 << 20, 1 << 20
#: Texts encoded before their ids are handed on.
BATCH_ROWS = 512
#: First window on each side of a boundary, in characters; it doubles.
WINDOW = 32
#: Places that cut every text: before white space, between letters and digits, and from these to ASCII punctuation.
_CUT = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])")
_RUN_OF = {True: regex.compile(r"[A-Za-z]*"), False: regex.compile(r"[0-9]*")}
_ASCII_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ASCII_DIGITS = frozenset("0123456789")
_known: dict[tuple[str, str], Codec] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder of a rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = encoding.encode_ordinary
        self._array = partial(encoding.encode_to_numpy, disallowed_special=())
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.lengths = [len(b) for b in self.bytes]
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str, leaf: int | None = None) -> list[int]:
        """The ids of text: those of its halves, joined."""
        leaf = leaf or LEAF_CHARS
        if len(text) <= leaf:
            return self.whole(text)
        middle = len(text) // 2
        return self.join(text[:middle], self.encode(text[:middle], leaf), text[middle:], self.encode(text[middle:], leaf))

    def encoded(self, text: str) -> np.ndarray:
        """The ids of text as an array; one that is no longer than a leaf never becomes a list."""
        return (self._array(text) if len(text) <= LEAF_CHARS else np.array(self.encode(text))).astype(np.int32)

    def _upto(self, ids: list[int], size: int) -> int:
        """How many of the first ids are size bytes; they end there, as size is a place that cuts every text."""
        sums, k = 0, 0
        while sums < size:
            sums += self.lengths[ids[k]]
            k += 1
        assert sums == size
        return k

    def _from_end(self, ids: list[int], size: int) -> int:
        """How many of the last ids are size bytes."""
        sums, k = 0, 0
        while sums < size:
            k += 1
            sums += self.lengths[ids[-k]]
        assert sums == size
        return k

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The ids of left + right, from a of left and b of right."""
        if not left or not right:
            return a + b
        width = WINDOW
        while True:
            begin, end = max(0, len(left) - width), min(len(right), width)
            cuts = [m.start() for m in _CUT.finditer(left, begin)] if begin else [0]
            after = next((m.start() for m in _CUT.finditer(right, 0, min(len(right), end + 1)) if m.start() > 0), None) if end < len(right) else len(right)
            if cuts and after is not None:
                first = cuts[-1] if begin else 0
                window = self.whole(left[first:] + right[:after])
                kept = len(a) - self._from_end(a, len(left[first:].encode()))
                return a[:kept] + window + b[self._upto(b, len(right[:after].encode())) :]
            if width > 8 * WINDOW and (made := self._join_in_run(left, a, right, b, width)) is not None:
                return made
            width *= 2

    def _join_in_run(self, left: str, a: list[int], right: str, b: list[int], width: int) -> list[int] | None:
        """The join inside a run of ASCII letters, or of digits, that reaches over width on both sides; None if it doesn't or if no window up to that stands."""
        kind = left[-1] in _ASCII_LETTERS
        known = _ASCII_LETTERS if kind else _ASCII_DIGITS
        if not (known.issuperset(left[-width:]) and known.issuperset(right[:width]) and len(left) > width and len(right) > width):
            return None
        back = list(accumulate(self.lengths[i] for i in reversed(a[-width:])))
        fore = list(accumulate(self.lengths[i] for i in b[:width]))
        size = WINDOW
        while size < width // 2:
            k, j = bisect.bisect_left(back, size) + 1, bisect.bisect_left(fore, size) + 1
            window = self.whole(left[len(left) - back[k - 1] :] + right[: fore[j - 1]])
            if self._stands(a[-k - 1], window[0]) and self._stands(window[-1], b[j]):
                return a[:-k] + window + b[j:]
            size *= 2
        return None

    def _stands(self, x: int, y: int) -> bool:
        return self.whole((self.bytes[x] + self.bytes[y]).decode()) == [x, y]

    def decode(self, ids: list[int], leaf: int | None = None) -> bytes:
        """The bytes of ids, concatenated by halves."""
        leaf = leaf or LEAF_CHARS
        if len(ids) <= leaf:
            return b"".join([self.bytes[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """The number of ids, the hash of their decimals joined by spaces, and that of the bytes they decode to."""
        return len(ids), hashlib.sha256(" ".join([self.decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _known:
        _known[path, pattern] = Codec(path, pattern)
    return _known[path, pattern]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row; none where there is no list."""
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), np.asarray(column.is_null()), strict=True):
        yield values[a:a] if null else values[a:b]


def reduce_tree(parts: list[tuple[str, list[int]]], own: Codec) -> list[int]:
    """The ids of the concatenation of parts, each (text, its ids): neighbours are joined level by level."""
    while len(parts) > 1:
        pairs = [(parts[i][0] + parts[i + 1][0], own.join(*parts[i], *parts[i + 1])) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(parts) // 2 * 2 :]
    return parts[0][1] if parts else []


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """doc_id, ids (array of ints) of each whole text."""
    path, pattern = path or default_path(), pattern or default_pattern()
    rows = picked(docs, id_col, text_col).toDF("doc_id", "text")
    size = F.length(F.coalesce("text", F.lit("")))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for a in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(a, BATCH_ROWS)
                ids = [own.encoded(t or "") for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    kept = rows.schema["doc_id"].dataType.simpleString()
    made = rows.filter(size <= long_chars).mapInArrow(short, f"doc_id {kept}, ids array<int>")
    return made.unionByName(_long(rows.filter(size > long_chars), kept, path, pattern, segment_chars))


def _long(rows: DataFrame, kind: str, path: str, pattern: str, segment_chars: int) -> DataFrame:
    """The same for texts that are dealt in segments. Rows that repeat are counted and encoded once."""
    spark = rows.sparkSession
    key = F.concat_ws(":", F.sha2("text", 256), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(2).to_pylist()):
                for k, at in enumerate(range(0, len(text), segment_chars)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([k]), pa.array([text[at : at + segment_chars]])], ["key", "doc_id", "k", "text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            for i, text in enumerate(b.column(3).to_pylist()):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns), pa.array([own.encode(text)], pa.list_(pa.int32()))], ["key", "doc_id", "k", "text", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, last = codec(path, pattern), [], None
        for b in batches:
            for i, (key, text, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 3, 4)), strict=True)):
                if last is not None and key != last[0]:
                    yield _whole(last, reduce_tree(parts, own))
                    parts = []
                last = (key, b.column(1).slice(i, 1))
                parts.append((text, ids))
        if last is not None:
            yield _whole(last, reduce_tree(parts, own))

    counts = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    segments = rows.select(key.alias("key"), "doc_id", "text").mapInArrow(cut, f"key string, doc_id {kind}, k long, text string").dropDuplicates(["key", "k"])
    coded = segments.mapInArrow(each, f"key string, doc_id {kind}, k long, text string, ids array<int>")
    whole = coded.repartition(partitions(spark), "key").sortWithinPartitions("key", "k").mapInArrow(joined, f"key string, doc_id {kind}, ids array<int>")
    return whole.join(counts, "key").select("doc_id", "ids", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("doc_id", "ids")


def _whole(row: tuple, ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[0]]), row[1], pa.array([ids], pa.list_(pa.int32()))], ["key", "doc_id", "ids"])


def decode(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text (binary) of rows doc_id, ids."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = [own.decode(x.tolist()) for x in _lists(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text binary")


def digest(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows doc_id, ids: the ids are decoded again."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            rows = [own.digest(x.tolist()) for x in _lists(b.column(1))]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
