"""Link graph, site tree, bounded walks and audits, all as joins over edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import doc_id, site_segments
from ..sources.shared import stored


# ---------------------------------------------------------------- edges


def resolved_edges(links: DataFrame, docs: DataFrame, *, one_way: bool = False) -> DataFrame:
    """links(src, tgt) whose target, and unless one_way whose source, is a document."""
    ids = docs.select("doc_id").distinct()
    out = links.join(ids.withColumnRenamed("doc_id", "tgt"), "tgt", "left_semi")
    return out if one_way else out.join(ids.withColumnRenamed("doc_id", "src"), "src", "left_semi")


def link_edges(typed: DataFrame, docs: DataFrame) -> DataFrame:
    """G1: one edge per (src, tgt) among documents from typed links (src_url, tgt_url, ...), ids by address."""
    keyed = typed.withColumn("src", doc_id(F.col("src_url"))).withColumn("tgt", doc_id(F.col("tgt_url"))).where("src <> tgt")
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("src", "tgt").orderBy("tgt_url", "anchor"))).where("_n = 1").drop("_n")
    return resolved_edges(first, docs)


def pages_without_links(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: number of documents with and without outgoing edges."""
    linked = edges.select(F.col("src").alias("doc_id")).distinct().withColumn("linked", F.lit(True))
    return docs.join(linked, "doc_id", "left").groupBy(F.coalesce("linked", F.lit(False)).alias("linked")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- walks


def qualified_walk(hubs: DataFrame, docs: DataFrame, edges: DataFrame, *, most_hops: int) -> DataFrame:
    """(hub, doc_id, hop): documents reached from each hub's seed in at most its hops over qualifying documents.

    hubs(hub, seed, hops, categories, doc_types, exclude_audience): every document
    on the way but the seed has a category or document type of the hub's lists
    and none of its excluded audiences. Tests are per document, so a breadth-first
    walk with a visited set gives all members. All hubs walk in one table.
    """
    lists = hubs.select("hub", "hops", "categories", "doc_types", "exclude_audience")
    steps = edges.select(F.col("src").alias("doc_id"), F.col("tgt")).distinct()
    seen = hubs.select("hub", F.col("seed").alias("doc_id"), F.lit(0).alias("hop"))
    frontier = seen.select("hub", "doc_id")
    for hop in range(1, most_hops + 1):
        reached = frontier.join(steps, "doc_id").select("hub", F.col("tgt").alias("doc_id")).distinct().join(seen, ["hub", "doc_id"], "left_anti")
        known = reached.join(docs.select("doc_id", "category", "doc_type", "audience"), "doc_id").join(lists, "hub").where(F.col("hops") >= hop)
        fits = F.coalesce(F.array_contains("categories", F.col("category")), F.lit(False)) | F.coalesce(F.array_contains("doc_types", F.col("doc_type")), F.lit(False))
        out = F.coalesce(F.array_contains("exclude_audience", F.col("audience")), F.lit(False))
        frontier = stored(known.where(fits & ~out).select("hub", "doc_id"))
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen


def memberships(members: DataFrame) -> DataFrame:
    """(doc_id, topic_hubs): sorted keys of the hubs that a document belongs to."""
    return members.groupBy("doc_id").agg(F.array_sort(F.collect_set("hub")).alias("topic_hubs"))


def hub_candidates(docs: DataFrame, edges: DataFrame, *, qualifies: Column, curated: Column, overview: Column, min_fanout: int = 5, limit: int = 50, stale: str = r"(?i)\b(archive|news)\b", penalised: Sequence[str] = ()) -> DataFrame:
    """Overview pages ranked by 2 x curated + inline qualified links; the limit applies before the penalties for stale titles and audiences."""
    out = edges.join(docs.select(F.col("doc_id").alias("tgt"), qualifies.alias("_q")), "tgt").where("_q").groupBy("src").agg(F.count_if(curated).alias("curated"), F.count_if(~curated).alias("inline"))
    scored = out.where(F.col("curated") + F.col("inline") >= min_fanout).join(docs.where(overview).select(F.col("doc_id").alias("src"), "title", "audience"), "src").withColumn("score", 2 * F.col("curated") + F.col("inline"))
    top = scored.orderBy(F.desc("score"), "src").limit(limit)
    factor = F.when(F.coalesce(F.col("title").rlike(stale), F.lit(False)), 0.1).otherwise(1.0) * F.when(F.coalesce(F.col("audience").isin(*penalised or ("",)), F.lit(False)), 0.2).otherwise(1.0)
    return top.select(F.col("src").alias("doc_id"), "title", "curated", "inline", F.round(F.col("score") * factor, 6).alias("score"))


# ---------------------------------------------------------------- site tree


def tree_records(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, parent_id, depth, path, ancestor_ids) of each document(doc_id, source_type, topic_path, source_url), without iteration.

    A linked PDF hangs under the smallest id of the pages that link to it and
    takes its path. Every other document hangs under its section: its own path
    less the last segment for a page, the whole path for an unlinked PDF. A page
    whose path is a section becomes that section, the smallest id of several.
    parent_id is null where no page stands for the section.
    """
    node = docs.select("doc_id", F.coalesce(F.col("source_type") == "pdf", F.lit(False)).alias("pdf"), site_segments(F.col("topic_path"), F.col("source_url")).alias("path"))
    linker = edges.join(node.where("pdf").select(F.col("doc_id").alias("tgt")), "tgt").join(node.where("not pdf").select(F.col("doc_id").alias("src")), "src").groupBy(F.col("tgt").alias("doc_id")).agg(F.min("src").alias("linker"))
    placed = node.join(linker, "doc_id", "left").withColumn("section", F.when(F.col("pdf"), F.col("path")).otherwise(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))))
    free = placed.where("linker is null")
    prefixes = free.select("doc_id", "path", "section", F.explode(F.when(F.size("section") > 0, F.sequence(F.lit(1), F.size("section"))).otherwise(F.array().cast("array<int>"))).alias("n")).select("doc_id", "n", F.slice("section", 1, F.col("n")).alias("prefix"))
    occupied = node.where("not pdf and size(path) > 0").groupBy(F.col("path").alias("prefix")).agg(F.min("doc_id").alias("occupant"))
    line = prefixes.join(occupied, "prefix").where("occupant <> doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "occupant"))).alias("line"))
    own = free.join(line, "doc_id", "left").withColumn("line", F.coalesce("line", F.array().cast("array<struct<n:int,occupant:string>>")))
    nearest = F.try_element_at("line", F.lit(-1))
    free_rows = own.select("doc_id", F.when(nearest["n"] == F.size("section"), nearest["occupant"]).alias("parent_id"), (F.size("section") + 1).alias("depth"), "path", F.transform("line", lambda x: x["occupant"]).alias("ancestor_ids"))
    hung = placed.where("linker is not null").select("doc_id", "linker").join(free_rows.select(F.col("doc_id").alias("linker"), "depth", "path", "ancestor_ids"), "linker")
    return free_rows.unionByName(hung.select("doc_id", F.col("linker").alias("parent_id"), (F.col("depth") + 1).alias("depth"), "path", F.concat("ancestor_ids", F.array("linker")).alias("ancestor_ids")))


def depth_histogram(records: DataFrame) -> DataFrame:
    """Documents and those with a document for a parent, per depth."""
    return records.groupBy("depth").agg(F.count(F.lit(1)).alias("docs"), F.count("parent_id").alias("parented"))


def subtree_counts(records: DataFrame) -> DataFrame:
    """(doc_id, weight): documents below each document, one at least."""
    below = records.select(F.explode("ancestor_ids").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return records.join(below, "doc_id", "left").select("doc_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long").alias("weight"))


# ---------------------------------------------------------------- audits


def degrees(edges: DataFrame, end: str = "tgt") -> DataFrame:
    """(doc_id, degree) at one end of the edges."""
    return edges.groupBy(F.col(end).alias("doc_id")).agg(F.count(F.lit(1)).alias("degree"))


def concentration(edges: DataFrame, tops: Sequence[int] = (1, 10, 50, 100)) -> DataFrame:
    """Share of edges that end in the top n targets, median and greatest in-degree."""
    d = degrees(edges)
    totals = d.agg(F.sum("degree").alias("edges"), F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"))
    heads = d.orderBy(F.desc("degree"), "doc_id").limit(max(tops)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("degree"), "doc_id")))
    sums = heads.agg(*(F.sum(F.when(F.col("r") <= n, F.col("degree"))).alias(f"top_{n}") for n in tops))
    return totals.crossJoin(sums).select("edges", F.col("median_degree").cast("double").alias("median_degree"), "max_degree", *(F.round(F.col(f"top_{n}") / F.col("edges"), 6).alias(f"share_{n}") for n in tops))


def repeated_anchors(edges: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent anchors, with the distinct sources of each."""
    return edges.groupBy("anchor").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("src").alias("sources")).orderBy(F.desc("uses"), "anchor").limit(n)


def neighbourhood(edges: DataFrame, doc: str | int, hops: int = 2) -> DataFrame:
    """Documents within hops of one document, whichever way the links go."""
    both = edges.select("src", "tgt").unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()
    seen = frontier = edges.sparkSession.range(1).select(F.lit(doc).alias("src"))
    for _ in range(hops):
        frontier = frontier.join(both, "src").select(F.col("tgt").alias("src")).distinct()
        seen = seen.unionByName(frontier).distinct()
    return seen.select(F.col("src").alias("doc_id")).where(F.col("doc_id") != F.lit(doc))


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have no chunk."""
    return docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(doc_id)."""
    return resolved_edges(edges, members)


def drill_downs(docs: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with their chunk, leaf, in-link and out-link counts; one document is a filter on the result, which reaches every scan."""
    owned = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("is_leaf").alias("leaves"))
    ends = lambda c, name: edges.groupBy(F.col(c).alias("doc_id")).agg(F.count(F.lit(1)).alias(name))
    joined = docs.join(owned, "doc_id", "left").join(ends("tgt", "links_in"), "doc_id", "left").join(ends("src", "links_out"), "doc_id", "left")
    return joined.na.fill(0, ["chunks", "leaves", "links_in", "links_out"])


def drill_down(docs: DataFrame, chunks: DataFrame, edges: DataFrame, doc: str | int) -> DataFrame:
    """One document's row of drill_downs."""
    return drill_downs(docs, chunks, edges).where(F.col("doc_id") == F.lit(doc))


def components(edges: DataFrame, *, small: int = 3) -> DataFrame:
    """(node, component, size, is_small): least node reachable, by rounds of least labels and jumps, each round stored."""
    both = edges.select(F.col("src").alias("a"), F.col("tgt").alias("b")).unionByName(edges.select(F.col("tgt").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()
    labels = stored(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("tgt").alias("node"))).distinct().withColumn("label", F.col("node")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(around, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("low"), "label")
        jumped = lowered.join(labels.select(F.col("node").alias("low"), F.col("label").alias("next")), "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("new"), "label")
        step = stored(jumped)
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            break
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, "label").select("node", F.col("label").alias("component"), "size", (F.col("size") < small).alias("is_small"))


def histogram(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """A1: (value, n) of a column with a (none) bucket, most frequent first."""
    out = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(n) if n else out


def coverage(df: DataFrame, columns: Sequence[str], by: str = "source_type") -> DataFrame:
    """A2: rows and non-null values of columns, per source type."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns))


def census(**tables: DataFrame) -> DataFrame:
    """A3: (name, n): rows of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_histogram(edges: DataFrame) -> DataFrame:
    """A5: edges by context and kind, with their share of all."""
    out = edges.groupBy("link_context", "kind").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def hub_sizes(docs: DataFrame) -> DataFrame:
    """Members per hub from the array column topic_hubs."""
    return docs.select(F.explode("topic_hubs").alias("hub")).groupBy("hub").agg(F.count(F.lit(1)).alias("members"))


def sampled_edges(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N edges in an order fixed by a seed."""
    return edges.orderBy(F.xxhash64("src", "tgt", F.lit(seed)), "src", "tgt").limit(n)
