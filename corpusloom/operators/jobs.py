"""Composite jobs: tables of a document graph, topic memberships, label enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pages import document_rows
from . import catalog, graph, tables
from .chunk import nested_chunks


def build_tables(parsed: DataFrame, typed_links: DataFrame, meta: DataFrame, badges: DataFrame, *, chunked: DataFrame | None = None, labels: Sequence[str] = ("audience", "site_topic"), sizes: Sequence[int] = (2048, 512, 128)) -> dict[str, DataFrame]:
    """R2: documents with labels, nested chunks of those that chunked(doc_id) doesn't have yet, and links among the documents."""
    docs = tables.label_documents(document_rows(parsed), meta, badges, labels)
    fresh = docs if chunked is None else graph.without_chunks(docs, chunked)
    return {"documents": docs.drop("text"), "chunks": nested_chunks(fresh, sizes=sizes), "links": graph.link_edges(typed_links, docs)}


def rebuilt_links(made: dict[str, DataFrame], typed_links: DataFrame) -> dict[str, DataFrame]:
    """The tables of build_tables with their links made anew from typed links; documents and chunks are as they were."""
    return made | {"links": graph.link_edges(typed_links, made["documents"])}


def build_memberships(hubs: DataFrame, docs: DataFrame, edges: DataFrame, meta: DataFrame, keys: Sequence[str], *, most_hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(meta, docs) with topic_hubs of this build's hubs; every seed must be a document. meta and docs are joined by doc_id."""
    catalog.unresolved_seeds(hubs, docs, fail=True)
    members = graph.memberships(graph.qualified_walk(hubs, docs, edges, most_hops=most_hops))
    stamped = tables.upsert_hubs(meta, members, keys, key="doc_id")
    base = docs if "topic_hubs" in docs.columns else docs.withColumn("topic_hubs", F.array().cast("array<string>"))
    return stamped, tables.propagate(base, stamped.select("doc_id", "topic_hubs"), ["topic_hubs"])


def enrich_labels(meta: DataFrame, badges: DataFrame, types: DataFrame, *, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """meta(url, audience, site_topic, doc_type) with the pages' badges and the export's document types, and a histogram of the types."""
    out = tables.upsert_labels(meta, badges.select("url", "audience", "site_topic"), ["audience", "site_topic"], group="badges", stamp=stamp)
    out = tables.upsert_labels(out, types.select("url", F.col("type").alias("doc_type")), ["doc_type"], group="doc_type", stamp=stamp, blank_is_null=True)
    return out, graph.histogram(out, "doc_type")
