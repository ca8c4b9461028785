"""Chunking: flat windows under Markdown headings, and nested windows of three sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chunk_id

LEAST_CHARS = 80


def tokens(text: Column) -> Column:
    """White-space tokens of a text."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def flat_chunks(docs: DataFrame, *, size: int = 512, overlap: int = 64, least: int = LEAST_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, heading_path, token_count, text): sections under Markdown headings, long ones cut into windows of size tokens that overlap.

    Chunks of fewer than least characters are left out before numbering.
    """
    sections = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n(?=#{1,6}\s)")).alias("section", "body"))
    heading = F.trim(F.regexp_replace(F.regexp_extract("body", r"^#{1,6}\s+([^\n]*)", 1), r"\*", ""))
    parts = sections.select(key, "section", F.nullif(heading, F.lit("")).alias("heading_path"), tokens(F.col("body")).alias("t"))
    step = size - overlap
    starts = F.when(F.size("t") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size("t") - overlap - 1, F.lit(0)), F.lit(step)))
    windows = parts.select(key, "section", "heading_path", "t", F.explode(starts).alias("start")).select(key, "section", "heading_path", "start", F.slice("t", F.col("start") + 1, F.lit(size)).alias("w"))
    whole = windows.select(key, "section", "start", "heading_path", F.size("w").alias("token_count"), F.array_join("w", " ").alias("text")).where(F.length("text") >= least)
    grouped = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "start", "heading_path", "token_count", "text"))).alias("c"))
    return grouped.select(key, F.posexplode("c").alias("chunk_index", "x")).select(key, "chunk_index", "x.heading_path", "x.token_count", "x.text")


def nested_chunks(docs: DataFrame, *, sizes: Sequence[int] = (2048, 512, 128), least: int = LEAST_CHARS, url: str = "url", text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, parent_id, level, chunk_index, is_leaf, text): windows of each size inside those of the next larger one.

    Ids number all nodes, parents before children, before chunks of fewer than
    least characters are dropped; a kept child may therefore name a dropped
    parent. A null or blank text has no chunks.
    """
    own = docs.select(F.sha2(F.col(url), 256).alias("doc_id"), tokens(F.coalesce(text, F.lit(""))).alias("t")).where(F.size("t") > 0)
    count = [F.ceil(F.size("t") / s).cast("int") for s in sizes]
    before = [F.lit(0)]
    for c in count[:-1]:
        before.append(before[-1] + c)
    levels = []
    for level, s in enumerate(sizes):
        at = own.select("doc_id", "t", F.explode(F.sequence(F.lit(0), count[level] - 1)).alias("w"), before[level].alias("b"), (before[level - 1] if level else F.lit(0)).alias("pb"))
        number = F.col("b") + F.col("w")
        parent = chunk_id(F.col("doc_id"), F.col("pb") + F.floor(F.col("w") * s / sizes[level - 1]).cast("int")) if level else F.lit(None).cast("string")
        levels.append(at.select("doc_id", chunk_id(F.col("doc_id"), number).alias("chunk_id"), parent.alias("parent_id"), F.lit(level).alias("level"), number.alias("chunk_index"), F.lit(level == len(sizes) - 1).alias("is_leaf"), F.array_join(F.slice("t", F.col("w") * s + 1, F.lit(s)), " ").alias("text")))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.where(F.length("text") >= least)
