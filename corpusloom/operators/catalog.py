"""Topic catalogs: members grouped, ranked, paged and cut to a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hub_key, substance


def grouped_members(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members(hub, doc_id, source_type) with group_id: the page of the same hub that links to a PDF (smallest id), else the member itself."""
    pages, files = members.where("source_type <> 'pdf'"), members.where("source_type = 'pdf'")
    parent = edges.join(files.select("hub", F.col("doc_id").alias("tgt")), "tgt").join(pages.select("hub", F.col("doc_id").alias("src")), ["hub", "src"]).groupBy("hub", F.col("tgt").alias("doc_id")).agg(F.min("src").alias("_p"))
    return members.join(parent, ["hub", "doc_id"], "left").withColumn("group_id", F.coalesce("_p", "doc_id")).drop("_p")


def unresolved_seeds(hubs: DataFrame, docs: DataFrame, *, fail: bool = False) -> DataFrame:
    """Hubs whose seed is no document; with fail, any such hub is an error."""
    out = hubs.join(docs.select(F.col("doc_id").alias("seed")), "seed", "left_anti")
    if fail and (lost := [r["hub"] for r in out.orderBy("hub").limit(20).select("hub").collect()]):
        raise ValueError(f"hub seeds that are no documents: {lost}")
    return out


def memberships_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask, hub) for asked(ask), which is an address or an id: two equi joins instead of one with OR."""
    by = lambda c: asked.join(docs.select(F.col(c).cast("string").alias("ask"), "topic_hubs"), "ask")
    return by("doc_id").unionByName(by("source_url")).select("ask", F.explode("topic_hubs").alias("hub")).distinct()


def within_budget(chunks: DataFrame, budget: int, *, by: str = "query_id", order: str = "rank", text: str = "text", per_token: int = 4) -> DataFrame:
    """Ranked chunks while their characters stay within per_token x budget; the first is always kept, the first overflow ends the list, blanks are passed over."""
    w = Window.partitionBy(by).orderBy(order)
    rows = chunks.where(F.trim(text) != "").withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_over", F.max(((F.col("_sum") > per_token * budget) & (F.col("_n") > 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_over = 0").drop("_sum", "_n", "_over")


def paged(groups: DataFrame, page: int, size: int, *, by: str = "hub") -> DataFrame:
    """One page of groups(score, title) per hub, by score (nulls last) or title, with pages, total and truncated; a page beyond the last has no rows."""
    order = [F.desc_nulls_last("score"), F.asc("title"), F.asc("group_id")]
    rows = groups.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(by)))
    rows = rows.withColumn("page", F.ceil(F.col("_n") / size).cast("int")).withColumn("pages", F.ceil(F.col("total") / size).cast("int")).withColumn("truncated", F.col("pages") > page)
    return rows.where(F.col("page") == page).withColumnRenamed("_n", "place")


def picked_hub(scored: DataFrame) -> DataFrame:
    """Per ask of scored(ask, hub, score) the hub whose seed scores best, ties to the larger key; without scores the smallest key."""
    return scored.groupBy("ask").agg(F.coalesce(F.max_by("hub", F.when(F.col("score").isNotNull(), F.struct("score", "hub"))), F.min("hub")).alias("hub"))


def fresh_candidates(candidates: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The n best candidates(doc_id, score) that aren't known seeds."""
    return candidates.join(known.select(F.col("seed").alias("doc_id")), "doc_id", "left_anti").orderBy(F.desc("score"), "doc_id").limit(n)


def substances(queries: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, limit: int = 15) -> DataFrame:
    """What is known of each query(query): fetch turns them into (query, payload) rows, from a table or a service; queries without a payload aren't found."""
    got = queries.select("query").distinct()
    found = got.join(fetch(got).select("query", "payload"), "query", "left")
    return found.select(substance(F.col("query"), F.coalesce("payload", F.lit("{}")), limit).alias("s")).select("s.*")


def hub_keys(candidates: DataFrame, existing: DataFrame, *, url: str = "source_url") -> DataFrame:
    """A key per candidate from its address, with a number where the key is taken or repeated."""
    keyed = candidates.withColumn("_k", hub_key(F.col(url)))
    taken = existing.select(F.regexp_replace("hub", r"_\d+$", "").alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_taken"))
    rows = keyed.join(taken, "_k", "left").withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(url)) + F.coalesce("_taken", F.lit(0)))
    return rows.withColumn("hub", F.when(F.col("_n") == 1, F.col("_k")).otherwise(F.concat("_k", F.lit("_"), F.col("_n").cast("string")))).drop("_k", "_n", "_taken")


def topic_catalog(members: DataFrame, edges: DataFrame, scores: DataFrame, *, page: int = 1, size: int = 20) -> DataFrame:
    """One page per hub of member groups by their best score, scores(doc_id, score) being optional per member."""
    grouped = grouped_members(members, edges).join(scores, "doc_id", "left")
    groups = grouped.groupBy("hub", "group_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("members"), F.min(F.when(F.col("doc_id") == F.col("group_id"), F.col("title"))).alias("title"))
    return paged(groups, page, size)
