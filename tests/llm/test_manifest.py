"""The Merkle manifest against plain trees, its log's addresses, and odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.llm import manifest
from tests.llm import brute

KIND = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows(n: int) -> list[tuple]:
    langs = [None, "de", "", "é", "en", "en", "en", "en"]
    return [(k, None if k % 11 == 0 else f"s{k % 5}", langs[k % 8], k * 3, None if k % 13 == 0 else f"Text {k} ÄB" * (k % 4)) for k in range(n)]


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 9, 64, 65, 700])
def test_positions_are_the_order_of_completion(n):
    """A stack that completes runs as leaves come gives each node its closed-form place."""
    at, height = 0, manifest.height(n)
    for leaf in range(n):
        index, level = leaf, 0
        while True:
            assert manifest.position(level, index, n) == at
            at += 1
            last = leaf == n - 1
            if level == height or not (last or (leaf + 1) % 8 ** (level + 1) == 0):
                break
            index, level = index // 8, level + 1


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_proofs_over_rounds(spark, levels):
    """Blocks of any depth give the same trees, in logs of gapless positions."""
    own = rows(600)
    docs = spark.createDataFrame(own, KIND).repartition(7)
    groups, whole = manifest.build(docs, levels)
    assert got(manifest.prove(groups, whole)) == sorted(brute.merkle_rows(own), key=str)
    log: dict = {}
    for r in groups.log.collect():
        log.setdefault((r.tree, r.n), []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in log.values()) and len(log) == 5


def test_odd_rows(spark):
    """Null ids and fields, rows that repeat, clashing columns; nothing at all."""
    own = [*rows(20), (None, None, None, None, None), (3, "s3", "é", 9, None), (5, "x", "en", None, "UPPER" * 5000), (5, "x", "en", None, "UPPER" * 5000)]
    docs = spark.createDataFrame(own, KIND).select("*", *[F.lit(1).alias(c) for c in ("tree", "index", "n", "digest", "_part", "block", "path")])
    assert got(manifest.manifest(docs)) == sorted(brute.merkle_rows(own), key=str)
    empty = manifest.manifest(docs.limit(0))
    assert empty.columns[:7] == list(COLUMNS) and empty.count() == 0


def test_changed_row_is_found(spark):
    """A proof no longer gives the root when its row's text has changed in case, and does for all others."""
    for r in manifest.manifest(spark.createDataFrame([(k, "s", "en", 5, "Abc" if k % 2 else "abc") for k in range(50)], KIND)).collect():
        assert r.verified == (r.folded_root == r.root)
        assert r.verified or r.doc_id % 2
