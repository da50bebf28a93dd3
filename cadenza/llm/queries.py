"""The thin queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, decontaminate as decontamination, lm, manifest, neardup, negatives, packing, passages, privacy, suffix, toxicity, warc
from .common import shared_path, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.deduplicate(table(spark, sf_dir, "documents")))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, deduplicated = shared_path(spark, "warc-raw"), shared_path(spark, "warc-deduplicated")
    warc.write_responses(table(spark, sf_dir, "pages"), raw)
    warc.deduplicate(spark, raw, deduplicated)
    return warc.read_archive(spark, deduplicated, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(decontamination.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicates(table(spark, sf_dir, "documents"))


def op5_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op7_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity_score")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_recurrent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("n_siblings")


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_monoid_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
