"""Null, empty, very long, tied and repeated rows, empty tables, and further columns with clashing names, for every operator and stage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import ann, decontaminate, lm, neardup, packing, passages, privacy, suffix, toxicity, warc
from cadenza.llm.common import shared_path
from tests.llm import brute
from tests.llm.test_contracts import check_packed

PROSE = " ".join(f"word{k % 97}x{k % 13}" for k in range(300))
ROWS = [
    (1, PROSE), (2, PROSE), (3, PROSE + " and one more"), (4, None), (5, ""), (6, "  "), (7, "short"), (7, "short"), (8, "short"),
    (9, "Write to ann@example.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (555) 010-9999."), (10, " ".join(f"w{k}" for k in range(30_000))),
    (11, "é" * 400 + " 語 " * 50), (12, "x" * 5000),
]
ITEMS = [(1, " ".join(PROSE.split()[20:60])), (2, "one more"), (3, None), (4, ""), (None, "write to ann"), (2, "one more")]


def odd(spark, rows):
    """The rows with further columns whose names operators use inside."""
    own = spark.createDataFrame(rows, "doc_id long, text string")
    return own.select("doc_id", "text", F.lit("other").alias("extra"), F.lit("z").alias("_0"), F.lit(1).alias("id"), F.lit(2.0).alias("v"), F.lit("n").alias("n"), F.lit("k").alias("key"))


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark, ROWS).cache()


def test_repeated_strings(docs):
    rows = {}
    for r in suffix.digest(suffix.deduplicate(docs)).collect():
        rows.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = brute.suffix_rows(dict(ROWS).items())
    assert {d: x[0] for d, x in rows.items()} == want and len(rows[7]) == 2 and len(set(rows[7])) == 1


def test_long_keys_in_shards(docs, monkeypatch):
    """A key beyond the bound is sorted in shards and merged by hashes, with the same result."""
    monkeypatch.setattr(suffix, "KEY_BYTES", 1)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 300)
    got = {r[0]: tuple(r)[1:] for r in suffix.digest(suffix.deduplicate(docs)).collect()}
    assert got == brute.suffix_rows(dict(ROWS).items())


def test_contamination(spark, docs):
    want = {r[0]: r for r in brute.contamination_rows(list(dict(ROWS).items()), [i for i in ITEMS if i[0] is not None])}
    for bound in (decontaminate.BROADCAST_WINDOWS, 0):  # broadcast, then shuffled
        hits = decontaminate.find_hits(docs, benchmark(spark, [i for i in ITEMS if i[0] is not None]), broadcast_windows=bound)
        got = [tuple(r) for r in decontaminate.judge(hits).collect()]
        assert len(got) == len(ROWS) and all(g == want[g[0]] for g in got)
        every = {r.doc_id: r for r in decontaminate.judge(decontaminate.find_hits(docs, benchmark(spark, ITEMS), broadcast_windows=bound)).collect()}
        assert every[9].n_hit == 3 and every[9].n_items == 0


def test_passages(docs):
    found = {(r.doc_id, r.of_doc_id) for r in passages.near_duplicates(docs).collect()}
    assert (2, 1) in found and {d for d, _ in found} == {2, 3} and all(e < d for d, e in found)


def test_personal_data(docs):
    got = privacy.report(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.personal_row(dict(ROWS)[r.doc_id])


def test_revealing_terms_by_brute_force(spark):
    """A name near the same address in different texts is a term; words of many other texts are not."""
    rows = [(k, f"note {k} of the day: Li wrote from li@host{k % 2}.org today") for k in range(8)] + [(100 + k, f"the day {k} was like the day before, of note") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near: dict[tuple, set] = {}
    every: dict[str, set] = {}
    entities: dict[str, set] = {}
    for d, t in rows:
        words = brute.re.findall(r"(?<![^\W_])[^\W\d_][^\W_]*|(?<![^\W_])\d+[^\W\d_][^\W_]*", t)
        for w in words:
            every.setdefault(w, set()).add(d)
        for a, k, b in brute.base_spans(t):
            e = t[a:b].lower()
            entities.setdefault(e, set()).add(d)
            for w in brute.re.findall(r"[^\W_]+", t[max(0, a - privacy.NEAR) : a]) + brute.re.findall(r"[^\W_]+", t[b : b + privacy.NEAR]):
                near.setdefault((e, w), set()).add(d)
    want = {w for (e, w), own in near.items() if w in every and len(own) >= privacy.SUPPORT and len(own) / len(every[w]) >= 0.6 and np.log2(len(own) / len(every[w]) * len(rows) / len(entities[e])) >= privacy.BITS}
    low = {r.term for r in privacy.revealing_terms(docs, share=0.4, bits=4.0).collect()}
    assert {r.term for r in privacy.revealing_terms(docs).collect()} == want
    assert "Li" in low and not low & {"the", "day", "of", "note"}


def test_similar_documents(docs):
    want = brute.similar(list(dict(ROWS).items()))
    got = [(r.doc_id, r.class_id, r.n_links) for r in neardup.join(docs).collect()]
    assert len(got) == len(ROWS) and all((c, n) == want[d] for d, c, n in got)


def test_similar_documents_in_blocks(spark, monkeypatch):
    """A template with one slot: many texts in one node, cut into blocks, each link counted once."""
    rng = np.random.default_rng(3)
    base = [f"t{x}" for x in rng.integers(0, 1 << 30, 60)]
    rows = [(k, " ".join([*base[: k % 50], f"slot{k}", *base[k % 50 + 1 :]])) for k in range(40)]
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 7)
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.similar(rows)


def test_chosen_depths_reach_the_recall():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 5000, (50, neardup.TREES, neardup.DEPTH - neardup.FLOOR + 1)), axis=2)[:, :, ::-1]
    depth = neardup.chosen_depths(sizes, 0.8, 0.999)
    reached = 1 - np.prod(1 - 0.8**depth, axis=1)
    assert ((reached >= 0.999) | (depth == neardup.FLOOR).all(1)).all() and len(np.unique(depth)) > 2


def test_toxicity(spark, docs):
    known = labels(spark, [(1, 1, 0), (2, 1, 1), (3, None, None), (None, 1, 1), (7, 0, 1), (9, 1, 0), (9, 1, 0)])
    for given in (known, labels(spark, [])):
        scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, given)).collect()
        assert len(scored) == len(ROWS) and all(0 <= r.toxicity_score <= 1 for r in scored)


def test_pairs_tell_what_single_terms_do_not():
    """Toxic where exactly one of two terms stands: no additive weights can tell, factors do."""
    rng = np.random.default_rng(2)
    a, b = rng.random(400) < 0.5, rng.random(400) < 0.5
    y = (a != b).astype(float)
    docs, slots = np.nonzero(np.stack([a, b], axis=1))
    machine = toxicity.Machine(hashes=np.array([1, 2])).fit(docs, slots, y, rounds=1500)
    right = lambda m: np.mean((m.margin(docs, slots, 400) > 0) == y)
    with_pairs = right(machine)
    machine.factors[:] = 0
    assert with_pairs == 1.0 and right(machine) < 0.8


def test_language_model(docs):
    want = brute.base_scores(ROWS)
    got = lm.score(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        out, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total) and r.base_score == pytest.approx(base) and r.score < 0


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert len(rows) >= len(ROWS)
    once = [r for r in rows if r.doc_id != 7]
    check_packed(rows, list(dict(ROWS).items()))
    assert len(rows) - len(once) == 2


def test_packing_exchanges_between_groups(spark):
    """Groups of ten pieces cannot all be packed well alone; exchange brings the bins close to the bound."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(300, 3000, 400)
    pieces = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(lengths)], "uid long, length long")
    placed = packing.assign(pieces, group=10).collect()
    used = len({r.sequence_id for r in placed})
    alone = sum(len(packing.best_fit(lengths[i : i + 10])[2]) for i in range(0, 400, 10))
    assert len(placed) == 400 and packing.lower_bound(lengths) <= used < alone
    room: dict[int, int] = {}
    for r in placed:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + int(lengths[r.uid])
    assert max(room.values()) <= packing.CAPACITY


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(300, x[0].tolist()), (300, x[0].tolist()), (301, None), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, []), (305, [1.0, None] * 4), (None, x[1].tolist()), (320, [1.0] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("ids", F.lit("x"))
    want = brute.nearest({k: np.array(v) for k, v in rows[:301]})
    got: dict[int, list] = {}
    for r in ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert np.mean([len(set(got[q]) & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_recall_over_many_shards(spark, monkeypatch):
    """Spread lengths and no clusters: the hard case; ten shards, and as one."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64)) * rng.lognormal(0, 0.3, (6000, 1))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    want = brute.nearest(dict(enumerate(x)))
    for rows in (600, ann.SHARD_ROWS):
        monkeypatch.setattr(ann, "SHARD_ROWS", rows)
        got: dict[int, set] = {}
        for r in ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_archives(spark):
    rows = [(1, "http://a", "page"), (2, "http://b", "page"), (3, None, None), (4, "http://d", ""), (5, "x\r\ny", "é" * 9), (5, "http://e", "é" * 9), (None, "http://f", "page"), (6, "http://g", "line\r\n\r\nline\r\n\r\n"), (7, "http://h", "z" * 100_000)]
    for given in (rows, []):
        pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("record_id", F.lit("x"))
        raw, out = shared_path(spark, "warc-a"), shared_path(spark, "warc-b")
        warc.write_responses(pages, raw)
        warc.deduplicate(spark, raw, out)
        first = warc.read_archive(spark, raw).collect()
        assert sorted((r.page_id or 0, r.payload) for r in first) == sorted((k or 0, h or "") for k, _, h in given)
        again = warc.read_archive(spark, out).collect()
        assert len(again) == len(given) and not {r.record_id for r in again} & {r.record_id for r in first}
        kinds = {(r.page_id, r.record_type, r.refers_to) for r in again}
        if given:
            assert {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 2), (5, "revisit", 5), (5, "response", None)} <= kinds
            by_id = {r.record_id: r for r in again}
            assert all(by_id[r.refers_to_record].payload_digest == r.payload_digest for r in again if r.record_type == "revisit")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, tmp_path, name):
    """Each stage alone: clean documents and all columns stay, empty tables give empty results."""
    benchmark(spark, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark, [(1, 1, 0), (2, 1, 0), (9, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    full, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0
    ids = [r.doc_id for r in full.collect()]
    if name == "best_fit_packing":
        assert set(ids) == {d for d, _ in ROWS}
        return
    assert full.columns == docs.columns
    gone = {"toxicity": set(), "ngram_jaccard_join": {2, 3, 8}, "benchmark_decontamination": {1, 2, 3, 9}, "pii": set()}[name]
    assert sorted(ids) == sorted(d for d, _ in ROWS if d not in gone)


def test_empty_tables(spark):
    none = odd(spark, []).select("doc_id", "text")
    frames = [suffix.digest(suffix.deduplicate(none)), passages.near_duplicates(none), privacy.report(none), neardup.join(none), lm.score(none), packing.pack(none), decontaminate.judge(decontaminate.find_hits(none, benchmark(spark, [])))]
    assert [f.count() for f in frames] == [0] * len(frames)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.search(vectors, vectors, 20).count() == 0
