"""Question-answer corpus: priority dedup with a log, filters, statistics, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dedup_key

LEAST_ANSWER = 100


def ranked_duplicates(records: DataFrame, *, question: str = "question", position: str = "input_pos") -> DataFrame:
    """Records with dedup_key, keep_rank (1 for the kept one) and kept_qa_id: a PDF's record beats a page's, else the first seen."""
    keyed = records.withColumn("dedup_key", dedup_key(F.col(question)))
    order = Window.partitionBy("dedup_key").orderBy((F.col("source_type") == "pdf").desc(), position)
    return keyed.withColumn("keep_rank", F.row_number().over(order)).withColumn("kept_qa_id", F.first("qa_id").over(order))


def deduplicated(records: DataFrame, **columns: str) -> DataFrame:
    return ranked_duplicates(records, **columns).where("keep_rank = 1").drop("keep_rank", "kept_qa_id", "dedup_key")


def dedup_log(records: DataFrame, *, question: str = "question", position: str = "input_pos") -> DataFrame:
    """Every dropped row, by input position, with the id of the row kept instead."""
    dropped = ranked_duplicates(records, question=question, position=position).where("keep_rank > 1")
    return dropped.select(position, F.col("qa_id").alias("dropped_qa_id"), "kept_qa_id", F.substring(question, 1, 80).alias("question_preview"), F.lit("duplicate; preferred source_type kept").alias("reason"))


def is_landing_page() -> Column:
    """low confidence, no cross references and a short answer."""
    return (F.col("extraction_confidence") == "low") & (F.size(F.coalesce("cross_refs", F.array().cast("array<string>"))) == 0) & (F.length("answer") < LEAST_ANSWER)


def filter_log(records: DataFrame) -> DataFrame:
    return records.where(is_landing_page()).select("qa_id", "source_url", F.substring("question", 1, 80).alias("question_preview"), F.lit("landing-page heuristic").alias("reason"))


def corpus_stats(total: DataFrame, kept: DataFrame, output: DataFrame) -> DataFrame:
    """A4: (metric, name, value): input, deduped, filtered and output rows, and output by source type and topic."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("name"), "value")
    by = lambda c: output.groupBy(F.coalesce(c, F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"by_{c}").alias("metric"), "name", "value")
    return one(total, "input").unionByName(one(kept, "after_dedup")).unionByName(one(output, "output")).unionByName(by("source_type")).unionByName(by("topic_path"))


def build_corpus(records: DataFrame) -> dict[str, DataFrame]:
    """The corpus, its two logs and its statistics, from records(qa_id, question, answer, source_type, input_pos, ...)."""
    kept = deduplicated(records)
    output = kept.where(~F.coalesce(is_landing_page(), F.lit(False)))
    return {"corpus": output, "dedup_log": dedup_log(records), "filter_log": filter_log(kept), "stats": corpus_stats(records, kept, output)}


def sentences(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence) of distinctive sentences: 80 characters and up, a capital among the first 30, no note openings; the first and last of a text with more than two are left out."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    good = F.filter(parts, lambda s: (F.length(s) >= 80) & F.substring(s, 1, 30).rlike(r"\p{Lu}") & ~s.startswith("Rev.") & ~s.startswith("See "))
    listed = docs.select(key, good.alias("_all")).select(key, F.when(F.size("_all") > 2, F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0)))).otherwise(F.col("_all")).alias("_all"))
    return listed.select(key, F.posexplode("_all").alias("pos", "sentence"))


def sampled_sentences(found: DataFrame, n: int, seed: int = 42, source: str = "source", key: str = "doc_id") -> DataFrame:
    """At most n sentences per source in an order fixed by a seed."""
    order = Window.partitionBy(source).orderBy(F.xxhash64(F.lit(seed), key, "pos"), key, "pos")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
