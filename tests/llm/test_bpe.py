"""Encoding by halves against the tokenizer on whole texts, decoding, and odd rows."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cadenza.llm import bpe, queries
from cadenza.llm.common import table

SF = "/root/testdata/sf0.001"
OWN = bpe.codec(bpe.default_path(), bpe.default_pattern())
PIECES = st.sampled_from(["'re", "'s", "'", " ", "  ", "\n", "\t ", "a", "the", "word", "ING", "1", "2024", "é", "語", "。", "🙂", " ", " ", "\x1c", "!", "--", ".", "x'll", "<|endoftext|>", "_", "ſ", "ab" * 9])


@given(st.one_of(st.lists(PIECES, max_size=60).map("".join), st.text(max_size=80)), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_halves_give_the_ids_of_the_whole(text, leaf):
    ids = OWN.whole(text)
    assert OWN.encode(text, leaf) == ids
    assert OWN.decode(ids, leaf) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab", "abc", "the", "ing", "0", "123", "é", "語", "!", "=", "'", " ", "\n", " \n", "qzx", "AaBb", "'s"])
def test_long_runs(unit):
    """One match without a cut, where windows grow inside the run or over all of it."""
    text = "x " + unit * (9000 // len(unit)) + " y"
    for leaf in (700, 1300, 4096):
        assert OWN.encode(text, leaf) == OWN.whole(text)


def test_random_letters_join_inside_the_run(monkeypatch):
    letters = "".join(chr(97 + int(c, 16)) for k in range(200) for c in hashlib.sha256(str(k).encode()).hexdigest())
    made = []
    plain = OWN._join_in_run
    monkeypatch.setattr(OWN, "_join_in_run", lambda *a: made.append(plain(*a)) or made[-1])
    assert OWN.encode(letters, 2000) == OWN.whole(letters) and any(m is not None for m in made)


def expected(text):
    ids = OWN.whole(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_monoid_tree_bpe(spark, SF).collect()}
    assert got == {d: expected(t) for d, t in texts.items()}


def test_odd_rows_and_segments(spark):
    """Null, empty, long and repeated texts, null ids, clashing columns; long ones in segments; nothing at all."""
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "short"), (4, "short"), (5, "long words " * 500), (5, "long words " * 500), (None, "z" * 3000), (6, "z" * 3000), (7, "é" * 2500 + " 語" * 700), (5, "other long words " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("ids", "key", "k", "n", "segment")])
    for options in ({}, {"long_chars": 1000, "segment_chars": 300}):
        coded = bpe.encode(docs, **options)
        got = sorted((tuple(r) for r in bpe.digest(coded).collect()), key=str)
        assert got == sorted(((d, *expected(t)) for d, t in rows), key=str)
        assert sorted(((r.doc_id, bytes(r.text).decode()) for r in bpe.decode(coded).collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
        assert bpe.digest(bpe.encode(docs.limit(0), **options)).count() == 0
