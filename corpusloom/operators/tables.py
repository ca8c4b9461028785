"""Keyed tables: label upserts with provenance, joins to documents, graph tables, map payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_rows(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The greatest row of each key by the other columns; nulls in keys are values like others."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows by key in place of old ones; of several new rows with a key the greatest counts."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(last_rows(new, key), allowMissingColumns=True)


def upsert_counts(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys matched, changed and were added."""
    rest = [c for c in new.columns if c not in key]
    both = new.dropDuplicates(list(key)).join(old.select(*key, F.struct(*rest).alias("_old")), list(key), "left")
    changed = ~F.struct(*(F.col(c) for c in rest)).eqNullSafe(F.col("_old"))
    return both.agg(F.count("_old").alias("matched"), F.count_if(F.col("_old").isNotNull() & changed).alias("modified"), F.count_if(F.col("_old").isNull()).alias("upserted"))


def upsert_labels(old: DataFrame, new: DataFrame, columns: Sequence[str], *, group: str, stamp: Column, key: str = "url", blank_is_null: bool = False) -> DataFrame:
    """The columns of new in place of old's wherever new has the key, nulls included, so that lost labels clear; stamps provenance_<group>."""
    value = (lambda c: F.nullif(F.col(c), F.lit(""))) if blank_is_null else F.col
    fresh = new.select(F.col(key).alias("_key"), *(value(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    mark = f"provenance_{group}"
    base = old if mark in old.columns else old.withColumn(mark, F.lit(None).cast("string"))
    joined = base.join(fresh, F.col(key) == F.col("_key"), "full_outer")
    out = [F.coalesce(key, "_key").alias(key)]
    for c in base.columns:
        if c != key:
            chosen = F.col(f"_{c}") if c in columns else stamp.cast("string") if c == mark else F.col(c)
            out.append(F.when(F.col("_new"), chosen).otherwise(F.col(c)).alias(c) if c in columns or c == mark else F.col(c))
    return joined.select(*out)


def upsert_hubs(old: DataFrame, new: DataFrame, build_keys: Sequence[str], *, key: str = "url") -> DataFrame:
    """This build's keys are taken off all rows and put on those of new; keys of other hubs stay; a key outside the build is an error."""
    own = F.array(*(F.lit(k) for k in build_keys))
    none = F.array().cast("array<string>")
    fresh = new.select(F.col(key).alias("_key"), F.col("topic_hubs").alias("_hubs"))
    joined = old.join(fresh, F.col(key) == F.col("_key"), "full_outer")
    strange = F.array_except(F.coalesce("_hubs", none), own)
    merged = F.array_sort(F.array_union(F.array_except(F.coalesce("topic_hubs", none), own), F.coalesce("_hubs", none)))
    hubs = F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("keys outside the build: "), F.array_join(strange, ", ")))).otherwise(merged)
    return joined.select(F.coalesce(key, "_key").alias(key), *(hubs.alias(c) if c == "topic_hubs" else F.col(c) for c in old.columns if c != key))


def label_documents(docs: DataFrame, meta: DataFrame, badges: DataFrame, columns: Sequence[str], *, key: str = "url") -> DataFrame:
    """Labels of documents: the metadata row's where there is one, its nulls included; else the page's own badges for HTML."""
    named = meta.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_m_{c}") for c in columns))
    own = badges.select(F.col(key).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    joined = docs.join(named, F.col(key) == F.col("_k"), "left").join(own, F.col(key) == F.col("_b"), "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_m_{c}")).otherwise(F.when(F.col("source_type") == "html", F.col(f"_b_{c}")))
    return joined.select(*(docs[c] for c in docs.columns if c not in columns), *(pick(c).alias(c) for c in columns), F.coalesce("_hit", F.lit(False)).alias("label_found"))


def with_raw_html(docs: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents with their raw page, one join instead of a lookup per row; of several pages of one address the first by its text."""
    return docs.join(raw.groupBy("url").agg(F.min("html").alias("html")), "url", "left")


def label_coverage(docs: DataFrame, labels: DataFrame, value: str, *, key: str = "doc_id", by: str = "source_type") -> DataFrame:
    """Documents, labelled ones and their share, per source type."""
    joined = docs.join(labels.select(key, F.col(value).alias("_v")), key, "left")
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.count("_v").alias("labelled"), F.round(F.avg(F.col("_v").isNotNull().cast("double")), 6).alias("share"))


def labels_by_group(meta: DataFrame, graph_docs: DataFrame, groups: Sequence[str]) -> dict[str, DataFrame]:
    """The rows of each label group: only those whose provenance names the group, only for documents in the graph."""
    here = meta.join(graph_docs.select("doc_id"), "doc_id", "left_semi")
    return {g: here.where(F.col("provenance")[g].isNotNull()) for g in groups}


def propagate(docs: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of labels set on the documents they name; others keep theirs."""
    fresh = labels.select("doc_id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = docs.join(fresh, "doc_id", "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(docs[c]).alias(c) if c in columns else docs[c] for c in docs.columns))


def graph_tables(docs: DataFrame, chunks: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Documents, chunks with their document and parent keys, and links among the documents."""
    from .graph import resolved_edges

    return {"documents": docs.dropDuplicates(["doc_id"]), "chunks": chunks.dropDuplicates(["chunk_id"]), "links": resolved_edges(links, docs).dropDuplicates(["src", "tgt"])}


def map_payload(nodes: DataFrame, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nodes with the number of each label in the sorted list of its values (-1 for none) and their in-degree."""
    out = nodes
    for c in columns:
        values = nodes.where(F.col(c).isNotNull()).select(c).distinct()
        numbered = values.withColumn(f"{c}_index", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(c)) - 1)
        out = out.join(numbered, c, "left").withColumn(f"{c}_index", F.coalesce(f"{c}_index", F.lit(-1)))
    degree = edges.groupBy(F.col("tgt").alias("doc_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(degree, "doc_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("long"))


def scoped(docs: DataFrame, *, prefixes: Sequence[str] = (), committees: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """documents under a topic prefix and of a committee, at most limit of them by address."""
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.coalesce(F.col("topic_path").startswith(p), F.lit(False))
        docs = docs.where(hit)
    if committees:
        docs = docs.where(F.col("committee").isin(*committees))
    return docs.orderBy("url").limit(limit) if limit else docs


def within_size(docs: DataFrame, most: int = 14 * 1024 * 1024, column: str = "markdown") -> DataFrame:
    """F8: rows whose text has at most that many bytes."""
    return docs.where(F.octet_length(column) <= most)
