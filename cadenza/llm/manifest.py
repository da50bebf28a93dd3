"""A Merkle manifest of a dataset: one postorder append log of hash trees, and proofs read from it.

Rows are the leaves of a tree for each group (lang), in order of their id; the
tops of all groups are the leaves of one more tree, whose top is the dataset's
root. Eight consecutive nodes make a parent; the last run may be shorter.

Leaves are numbered within their group by a range sort and the sizes of the
ranges, and dealt to builders in blocks that are aligned to ARITY**levels leaves, so
that the nodes a builder completes are a whole subtree. It writes them in the
order in which they are completed. Where a node then stands in the log of its
tree follows from the sizes of the subtrees before it (`position`), without a
look at the log: builders never wait for each other, and proofs address siblings
by position. The tops of the blocks are built on by the next round, a block's
worth fewer each time. Proofs go down the same rounds: what lies above a block is
found once and shared by all of its leaves.

Defined cases: null fields are hashed as `-`; a null group is a group of its own
before all others; a null id comes first in its group, and its text is never
lower-cased; rows that repeat are leaves of their own, in order of their hash; an
empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, picked, split_join, written

ARITY = 8
#: Levels of a block: a builder takes ARITY ** LEVELS nodes at most.
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOG = "tree string, n long, level int, index long, position long, digest string"
_PAIRS = "array<struct<before: string, after: string>>"


def parent_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    """Levels above the leaves."""
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def position(level: int, index: int, n: int) -> int:
    """Where a node of a tree of n leaves stands in postorder: as many nodes are completed before it.

    Up to its last leaf, `end` leaves are there: all nodes that they fill up to the
    node's own level are complete, and of higher levels only those that ended before.
    """
    end = min((index + 1) * ARITY**level, n)
    own = sum(-(-end // ARITY**k) for k in range(level + 1))
    return own - 1 + sum((end - 1) // ARITY**k for k in range(level + 1, height(n) + 1))


def _field(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """The hash of a row's fields, each with its length before it; text may stand for another text."""
    fields = [_field(f) for f in FIELDS[:-1]]
    body = F.col("text") if text is None else text
    fields.append(F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the group as a string that is never null, in order of groups), doc_id, digest, tampered (that of the lower-cased text, where ids ask for it)."""
    asked = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return picked(docs, *FIELDS).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("digest"), F.when(asked, leaf_hash(F.translate("text", UPPER, LOWER))).alias("tampered"))


@dataclass
class Forest:
    """leaves: tree, index, n, digest and further columns; log: the nodes of all trees; tops: tree, n, digest; rounds of building and levels of each."""

    leaves: DataFrame
    log: DataFrame
    tops: DataFrame
    rounds: int
    levels: int


def _numbered(items: DataFrame, *order: str) -> DataFrame:
    """items (written) with index in their tree and its number of leaves, n: ranges are sorted apart and the sizes of those before are added."""
    by = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    names = items.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields), "_part int, _at long"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], [*names, "_part", "_at"])
            at += b.num_rows

    ordered = written(items.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(counted, schema), "manifest-leaves")
    sizes = sorted(map(tuple, ordered.groupBy("_part").count().collect()))  # a row for each partition
    starts = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes[:-1])]).tolist(), strict=True)) if sizes else {0: 0}
    place = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_part")].cast("long") + F.col("_at")
    placed = ordered.withColumn("_place", place)
    trees = placed.groupBy("tree").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n"))
    joined = split_join(placed, trees, "tree", sum(n for _, n in sizes))
    return joined.select(*names, (F.col("_place") - F.col("_first")).alias("index"), "n")



class _Builder:
    """Takes the nodes of one block in order and gives every node that they complete."""

    def __init__(self, tree: str, block: int, n: int, base: int, levels: int) -> None:
        self.key, self.n, self.base, self.tree = (tree, block), n, base, tree
        self.top = min(base + levels, height(n))
        self.last = min((block + 1) * ARITY**levels, width(n, base)) - 1
        self.open: list[list[str]] = [[] for _ in range(levels + 1)]

    def _row(self, level: int, index: int, digest: str) -> tuple:
        return self.tree, self.n, level, index, position(level, index, self.n), digest

    def add(self, index: int, digest: str) -> Iterator[tuple]:
        if self.base == 0:
            yield self._row(0, index, digest)
        level, last = self.base, index == self.last
        while level < self.top:
            run = self.open[level - self.base]
            run.append(digest)
            if len(run) < ARITY and not last:
                return
            digest, index, level = parent_hash(run), index // ARITY, level + 1
            run.clear()
            yield self._row(level, index, digest)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_LOG_ARROW = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("position", pa.int64()), ("digest", pa.string())])


def _appended(base: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = None
        for b in batches:
            out: list[tuple] = []
            for tree, block, index, n, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if builder is None or builder.key != (tree, block):
                    builder = _Builder(tree, block, n, base, levels)
                out.extend(builder.add(index, digest))
            yield _columns(out, _LOG_ARROW)

    return run


def _block(level: Column | int, top: int) -> Column:
    """The block, of those that end at level top, that a node of this level belongs to."""
    return F.floor(F.col("index") / F.pow(F.lit(float(ARITY)), F.lit(top) - level)).cast("long")


def _above(level: int) -> Column:
    """Whether a tree has nodes above this level."""
    return F.col("n") > ARITY**level


def grow(items: DataFrame, *order: str, levels: int = LEVELS) -> Forest:
    """The trees of items (tree, digest and further columns) in the given order, built in rounds of so many levels."""
    spark = items.sparkSession
    rows = _numbered(items, *order)
    most = rows.agg(F.max("n")).first()[0] or 1
    rounds = max(1, -(-height(most) // levels))
    log, nodes = None, rows.select("tree", "index", "n", "digest")
    for r in range(rounds):
        base = r * levels
        dealt = nodes.select("tree", _block(base, base + levels).alias("block"), "index", "n", "digest").repartition(partitions(spark), "tree", "block").sortWithinPartitions("tree", "block", "index")
        made = written(dealt.mapInArrow(_appended(base, levels), _LOG), "manifest-log")
        log = made if log is None else log.unionByName(made)
        nodes = made.filter((F.col("level") == base + levels) & _above(base + levels)).select("tree", "index", "n", "digest")
    tops = log.filter((F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level"))) & ((F.col("level") == 0) | (F.col("n") > F.pow(F.lit(float(ARITY)), F.col("level") - 1)))).select("tree", "n", "digest")
    return Forest(rows, log, tops, rounds, levels)


class _Prover:
    """The nodes of one block by position, and what lies above it; gives the siblings of its nodes up to the root."""

    def __init__(self, tree: str, block: int, n: int, base: int, levels: int, above: list[tuple[str, str]], top: str) -> None:
        self.key, self.n, self.base, self.top = (tree, block), n, base, top
        self.levels = min(base + levels, height(n))
        self.nodes: dict[int, str] = {}
        self.paths: dict[tuple[int, int], list[tuple[str, str]]] = {}
        self.run: tuple[tuple[int, int], list[str]] = (-1, -1), []
        self.above = above

    def siblings(self, level: int, index: int) -> tuple[str, str]:
        first = index // ARITY * ARITY
        if self.run[0] != (level, first):
            self.run = (level, first), [self.nodes[position(level, k, self.n)] for k in range(first, min(first + ARITY, width(self.n, level)))]
        run = self.run[1]
        return "".join(run[: index - first]), "".join(run[index - first + 1 :])

    def path(self, level: int, index: int) -> list[tuple[str, str]]:
        """(digests before, digests after) for each level from this one to the root."""
        if level >= self.levels:
            return self.above
        key = (level, index)
        if key not in self.paths:
            self.paths[key] = [self.siblings(level, index), *self.path(level + 1, index // ARITY)]
        found = self.paths[key]
        if level == self.base:
            del self.paths[key]
        return found


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest gives with its siblings."""
    for before, after in path:
        digest = hashlib.sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


def _proved(base: int, levels: int, emit: Callable[[_Prover, dict, list], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by block: first what lies above it (kind 0), then its nodes (1), then those whose proofs are wanted (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prover = None
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                if row["kind"] == 0:
                    prover = _Prover(row["tree"], row["block"], row["n"], base, levels, [(p["before"], p["after"]) for p in row["path"]], row["top"])
                elif row["kind"] == 1:
                    prover.nodes[row["at"]] = row["digest"]
                else:
                    out.append(emit(prover, row, prover.path(base, row["at"])))
            yield _columns(out, schema)

    return run


def _descend(forest: Forest, r: int, above: DataFrame, wanted: DataFrame, emit: Callable, names: str, schema: pa.Schema) -> DataFrame:
    """One round of proofs. above: tree, block, n, path, top; wanted: tree, index, digest, and doc_id and tampered at the leaves."""
    levels, spark = forest.levels, forest.log.sparkSession
    base = r * levels
    none = lambda kind: F.lit(None).cast(kind)
    inside = F.col("level").between(base, base + levels - 1) & _above(base)
    parts = [
        above.select("tree", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "n", none("string").alias("digest"), none("string").alias("tampered"), none("long").alias("doc_id"), "path", "top"),
        forest.log.filter(inside).select("tree", _block(F.col("level"), base + levels).alias("block"), F.lit(1).alias("kind"), F.col("position").alias("at"), "n", "digest", none("string").alias("tampered"), none("long").alias("doc_id"), none(_PAIRS).alias("path"), none("string").alias("top")),
        wanted.select("tree", _block(base, base + levels).alias("block"), F.lit(2).alias("kind"), F.col("index").alias("at"), none("long").alias("n"), "digest", "tampered", "doc_id", none(_PAIRS).alias("path"), none("string").alias("top")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(partitions(spark), "tree", "block").sortWithinPartitions("tree", "block", "kind", "at")
    return rows.mapInArrow(_proved(base, levels, emit, schema), names)


_PATH_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))), ("top", pa.string())])


def _path_row(prover: _Prover, row: dict, path: list[tuple[str, str]]) -> tuple:
    return prover.key[0], row["at"], prover.n, [{"before": a, "after": b} for a, b in path], prover.top


def _paths(forest: Forest, above: DataFrame, emit: Callable, names: str, schema: pa.Schema) -> DataFrame:
    """Proofs of all leaves. above: tree, path, top, for each tree; rounds go down from the highest."""
    tops = forest.tops.select("tree", "n").join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "n", "path", "top")
    lower = lambda r: F.lit(True) if r == 0 else _above(r * forest.levels)
    known = None
    for r in range(forest.rounds - 1, 0, -1):
        here = tops.filter(lower(r) & ~_above((r + 1) * forest.levels))
        known = here if known is None else here.unionByName(known)
        wanted = forest.log.filter((F.col("level") == r * forest.levels) & _above(r * forest.levels)).select("tree", "index", "digest", F.lit(None).cast("string").alias("tampered"), F.lit(None).cast("long").alias("doc_id"))
        known = written(_descend(forest, r, known, wanted, _path_row, f"tree string, block long, n long, path {_PAIRS}, top string", _PATH_ARROW), "manifest-paths")
    here = tops.filter(~_above(forest.levels))
    known = here if known is None else here.unionByName(known)
    return _descend(forest, 0, known, forest.leaves, emit, names, schema)


def build(docs: DataFrame, levels: int = LEVELS) -> tuple[Forest, Forest]:
    """The trees of all groups, and the tree over their tops. Both logs are written to the shared folder."""
    groups = grow(leaves(docs), "doc_id", "digest", levels=levels)
    tops = groups.tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", F.lit(None).cast("string").alias("tampered"), F.lit(None).cast("long").alias("doc_id"))
    return groups, grow(tops, "group", levels=levels)


_PROOF_ARROW = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("n_siblings", pa.int64())])


def _proof_row(prover: _Prover, row: dict, path: list[tuple[str, str]]) -> tuple:
    proof = "".join(x for pair in path for x in pair)
    return row["doc_id"], row["digest"], prover.top, hashlib.sha256(proof.encode()).hexdigest(), fold(row["tampered"] or row["digest"], path), len(proof) // 64


def prove(groups: Forest, whole: Forest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings for each leaf."""
    root = [r.digest for r in whole.tops.select("digest").limit(1).collect()]
    own = whole.leaves.select("tree", "index", "digest", "tampered", "doc_id")
    start = whole.tops.select("tree", F.array().cast(_PAIRS).alias("path"), F.lit("").alias("top"))
    tops = _paths(Forest(own, whole.log, whole.tops, whole.rounds, whole.levels), start, _path_row, f"tree string, block long, n long, path {_PAIRS}, top string", _PATH_ARROW)
    above = written(whole.leaves.select(F.col("group").alias("tree"), "index", F.col("digest").alias("top")).join(tops.select(F.col("block").alias("index"), "path"), "index").select("tree", "path", "top"), "manifest-tops")
    names = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, n_siblings long"
    made = _paths(groups, above, _proof_row, names, _PROOF_ARROW)
    root_of_all = F.lit(root[0] if root else None).cast("string")
    return made.select("doc_id", "leaf", "subroot", root_of_all.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_of_all).alias("verified"), "n_siblings")


def manifest(docs: DataFrame) -> DataFrame:
    """Builds the manifest of docs and proves every row, tampered with where its id asks for that."""
    return prove(*build(docs))
