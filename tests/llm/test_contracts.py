"""The ten queries and the pipeline against brute force, on the smallest tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import neardup, oracles, packing, passages, queries, toxicity
from cadenza.llm.common import table
from cadenza.llm.tokens import default_path
from tests.llm import brute
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(Q[name](spark, SF), oracles.oracle_sql()[name], SF)


def test_repeated_strings(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in Q["op1_suffix_array_dedup"](spark, SF).collect()}
    assert got == brute.suffix_rows(docs)


def test_contamination(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = [tuple(r) for r in Q["op3_benchmark_decontamination"](spark, SF).collect()]
    assert sorted(got) == sorted(brute.contamination_rows(docs, items))


def test_passages_cover_exact_repeats(spark, docs):
    """Each document that repeats fifty words of an earlier one is reported, and what is reported is alike."""
    found = Q["op4_compact_window_passages"](spark, SF).collect()
    texts = dict(docs)
    first: dict[tuple, int] = {}
    repeats = set()
    for doc, text in sorted(docs):
        w = brute.words(text)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), doc) != doc:
                repeats.add(doc)
    assert repeats <= {r.doc_id for r in found}
    for r in found:
        assert r.of_doc_id < r.doc_id
        a = brute.shingles(" ".join(brute.words(texts[r.doc_id])[r.start_word : r.start_word + r.n_words]))
        b = brute.shingles(" ".join(brute.words(texts[r.of_doc_id])[r.of_start_word : r.of_start_word + r.of_words]))
        assert min(r.n_words, r.of_words) >= passages.PASSAGE
        assert len(a & b) / len(a | b) == pytest.approx(r.jaccard) and r.jaccard >= 0.8


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in Q["op5_disclosure_sanitisation"](spark, SF).collect()}
    for doc, text in docs:
        r = got[doc]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.personal_row(text)
        base = {f"{brute.KINDS[k]}:{a}:{b}" for a, k, b in brute.base_spans(text)}
        spans = r.spans.split(",") if r.spans else []
        assert base <= set(spans) and len(spans) == len(set(spans))
        assert [s for s in spans if s in base] == sorted(base, key=lambda s: (int(s.split(":")[1]), brute.KINDS.index(s.split(":")[0])))


def test_similar_documents(spark, docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in Q["op6_ngram_jaccard_join"](spark, SF).collect()}
    assert got == brute.similar(docs)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q["op7_factorization_toxicity"](spark, sf).collect()}
    assert all(r.held_out == brute.fold(d, 3) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())
    labels = [(got[r.doc_id], r.toxic) for r in table(spark, sf, "labels").collect() if r.doc_id in got]
    held = [(r, y) for r, y in labels if r.held_out]
    toxic, clean = [r.predicted for r, y in held if y], [r.predicted for r, y in held if not y]
    assert np.mean(toxic) >= 0.75 and np.mean(clean) <= 0.01


def test_language_model(spark, docs):
    got = {r.doc_id: r for r in Q["op8_recurrent_scoring"](spark, SF).collect()}
    want = brute.base_scores(docs)
    assert got.keys() == want.keys()
    for doc, (out, n, known, total, base) in want.items():
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def tokens_of(texts):
    tokenizer = Tokenizer.from_file(default_path())
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packed(rows, docs, capacity=4096):
    want = {}
    for (doc, _), ids in zip(docs, tokens_of([t for _, t in docs]), strict=True):
        for p, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a : a + capacity]
            want[doc, p] = (a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), packing.lower_bound(np.array([n for _, n, _ in want.values()]), capacity)


def test_packing(spark, docs):
    used, bound = check_packed(Q["op9_best_fit_packing"](spark, SF).collect(), docs)
    assert bound <= used <= bound + 1


def test_nearest_neighbours(spark):
    want = brute.nearest({r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()})
    got: dict[int, list] = {}
    for r in Q["op10_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, len(want[q]) + 1))
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    exact = {(q, v): s for q, own in want.items() for v, s in own}
    assert all(s == pytest.approx(exact[q, v], abs=1e-12) for q, own in got.items() for _, v, s in own if (q, v) in exact)


def test_pipeline(spark, docs):
    """Its stages in turn: what the machine rejects, groups, contaminated texts, spans, pieces."""
    documents = table(spark, SF, "documents")
    scores = {r.doc_id: r.toxicity_score for r in toxicity.score(documents, toxicity.train(documents, table(spark, SF, "labels"))).collect()}
    left = [(d, t) for d, t in docs if scores[d] < toxicity.THRESHOLD]
    same = brute.similar(left)
    left = [(d, t) for d, t in left if same[d][0] == d]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in brute.contamination_rows(left, items) if r[5]}
    left = [(d, t) for d, t in left if d not in bad]
    stage = dict(corpus_pipeline.STAGES)["pii"]
    reported = {r.doc_id: r.spans for r in queries.privacy.report(spark.createDataFrame(left, "doc_id long, text string")).collect()}
    clean = []
    for d, t in left:
        out, at = "", 0
        for kind, a, b in (s.split(":") for s in reported[d].split(",") if s):
            if int(a) >= at:
                out, at = out + (t or "")[at : int(a)] + f"[{kind.upper()}]", int(b)
            else:
                at = max(at, int(b))
        clean.append((d, out + (t or "")[at:]))
    assert {r.doc_id: r.text or "" for r in stage(spark, spark.createDataFrame(left, "doc_id long, text string"), SF).collect()} == dict(clean)
    check_packed(corpus_pipeline.run(spark, SF).collect(), clean)


def test_threshold_is_exact():
    """0.8 as a double times a whole number never excludes a pair at exactly 0.8."""
    n = np.arange(5, 2_000_000, 5)
    assert (n * 4 // 5 >= neardup.THRESHOLD * n).all()
