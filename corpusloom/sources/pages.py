"""Sources and sinks: raw pages, parsed documents, label exports, corpora, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.scalars import doc_id


def _single(df: DataFrame, name: str) -> Column:
    """A value, or the first of a one-element list."""
    return F.get(name, F.lit(0)) if isinstance(df.schema[name].dataType, ArrayType) else F.col(name)


def raw_pages(raw: DataFrame, *, url: str = "url", html: str = "html_raw", content_type: str = "content_type") -> DataFrame:
    """(url, html, content_type) of raw(url, html_raw, content_type), one-element lists unwrapped, rows without address or page dropped."""
    kind = _single(raw, content_type) if content_type in raw.columns else F.lit(None).cast("string")
    rows = raw.select(_single(raw, url).alias("url"), _single(raw, html).alias("html"), F.lower(kind).alias("content_type"))
    return rows.where((F.col("url") != "") & (F.col("html") != ""))


def parsed_documents(parsed: DataFrame, *, prefixes: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Parsed documents without error, of type pdf or html, one row per address (the latest parse), under the prefixes of topic_path."""
    rows = parsed.where((F.coalesce("error", F.lit("")) == "") & F.lower(F.coalesce("content_type", F.lit(""))).rlike("pdf|html"))
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.coalesce(F.col("topic_path").startswith(p), F.lit(False))
        rows = rows.where(hit)
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("parsed_at"), "parser"))).where("_n = 1").drop("_n")
    return one.orderBy("url").limit(limit) if limit else one


def qa_records(html_records: DataFrame, pdf_records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (records, errors): both kinds of records as one table; rows without id, question or answer go to errors."""
    both = html_records.unionByName(pdf_records, allowMissingColumns=True)
    bad = F.coalesce((F.col("qa_id") == "") | (F.col("question") == "") | (F.col("answer") == ""), F.lit(True))
    return both.where(~bad), both.where(bad)


def document_rows(parsed: DataFrame) -> DataFrame:
    """Usable parsed documents with id, header metadata and size in bytes."""
    from ..functions import scalars as S

    head = S.header_metadata(F.col("text"))
    return parsed.where((F.coalesce("url", F.lit("")) != "") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("url", doc_id(F.col("url")).alias("doc_id"), S.title_or_tail(F.col("text"), F.col("url")).alias("title"), S.source_type(F.col("content_type"), F.col("url")).alias("source_type"), S.topic_path(F.col("url")).alias("topic_path"), head.alias("_h"), F.octet_length("text").alias("raw_byte_size"), "text").select("*", "_h.*").drop("_h")


def document_types(spark: SparkSession, path: str) -> DataFrame:
    """(url, type) of a malformed JSON export: records by their braces, two fields by pattern, the last type per address.

    Lines end at closing braces, wherever line breaks stand, so a large file is
    read in splits; what follows the last brace counts if it has both fields.
    Records follow each other by file, split and place.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("pos"), F.regexp_extract("value", r"\{([^{}]*)$", 1).alias("r"))
    field = lambda n: F.regexp_extract("r", rf'"{n}"\s*:\s*"([^"]*)"', 1)
    named = rows.select("pos", field("document_url").alias("url"), field("type").alias("type")).where("url <> ''")
    return named.groupBy("url").agg(F.max_by("type", "pos").alias("type"))


def write_corpus(parts: dict[str, DataFrame], folder: str) -> None:
    """Each part of a corpus build as JSON lines in a folder of its own."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_inventory(rows: DataFrame, folder: str) -> None:
    """An inventory as CSV with a header."""
    rows.write.mode("overwrite").csv(folder, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_sentences(rows: DataFrame, folder: str) -> None:
    """Sentences as tab-separated values with a header."""
    rows.write.mode("overwrite").csv(folder, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """A table's next version in a folder of its own; readers switch when it is whole."""
    out = f"{folder}/v={version}"
    df.write.mode("overwrite").parquet(out)
    return out


def projected(docs: DataFrame, edges: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Some columns of the documents, and the edges among them."""
    from ..operators.graph import resolved_edges

    return docs.select("doc_id", *columns), resolved_edges(edges, docs)


def page_file_subset(pages: DataFrame, links: DataFrame, files: DataFrame, *, per_page: int = 5, most_pages: int | None = None, most_files: int | None = None) -> DataFrame:
    """(page_id, file_url) of pages whose links lead to stored files, per_page at most of each page."""
    rows = links.join(files.select(F.col("url").alias("tgt_url")).distinct(), "tgt_url").join(pages.select("page_id"), "page_id", "left_semi")
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("tgt_url"))).where(F.col("_n") <= per_page).select("page_id", F.col("tgt_url").alias("file_url"))
    if most_pages:
        kept = kept.join(kept.select("page_id").distinct().orderBy("page_id").limit(most_pages), "page_id", "left_semi")
    return kept.orderBy("page_id", "file_url").limit(most_files) if most_files else kept
