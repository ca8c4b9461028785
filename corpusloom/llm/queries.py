"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_prefix, hard_negatives, line_spread, odd_sketches, packing, page_wrapper, phrase_fingerprints, quality_knn, repeat_spans, secret_links, simhash_golay, source_divergence, webp_media
from .common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprints.with_neighbours(table(spark, sf_dir, "documents"))


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_spread.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp_media.stored_and_read(table(spark, sf_dir, "documents"))


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_knn.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.report(table(spark, sf_dir, "documents"))


def op9_page_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrapper.main_texts(table(spark, sf_dir, "pages"))


def op10_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, and each source's foremost terms, over all documents."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive among all embeddings."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by shingles of four words."""
    return odd_sketches.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_phrase_fingerprints": op1_phrase_fingerprints,
    "op2_line_spread": op2_line_spread,
    "op3_webp_media": op3_webp_media,
    "op4_quality_knn": op4_quality_knn,
    "op5_packing": op5_packing,
    "op6_repeat_spans": op6_repeat_spans,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_secret_links": op8_secret_links,
    "op9_page_wrapper": op9_page_wrapper,
    "op10_bpe_prefix": op10_bpe_prefix,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_odd_sketches": op13_odd_sketches,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_line_spread": line_spread.oracle(),
    "op11_source_divergence": source_divergence.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
}
