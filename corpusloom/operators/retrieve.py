"""Batch retrieval: a table of queries against a table of chunks.

queries(query_id, vec) and chunks(chunk_id, vec, ...) hold vectors, both tables of
any size. Chunks are packed into blocks of bounded size, those near one pivot
together, with their centre and radius. A query first meets the block whose centre
is nearest, whose k-th score bounds what can win; then only blocks that can still
hold a winner. No vector of a query or chunk passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CATEGORIES, ROUTES, keyword_pattern
from ..functions.scalars import similarity
from ..sources.shared import stored

#: Chunks of a block, queries that meet it at once, chunks from which on they are dealt to pivots, and how many pivots at most.
CHUNK_BLOCK, ASKED, LEAST_DEALT, PIVOTS = 4096, 8192, 1 << 16, 256
#: Queries of a part and cells of a table of scores where each query meets every chunk; rows from which on a document is split, and partitions at most.
ASKED_ALL, SCORES, LARGE, MOST_TASKS = 2048, 1 << 19, 1024, 1 << 14
#: Up to so many blocks the driver knows centres of, to bound their scores; with more of them each query meets all.
CENTRES = 1 << 14


def best(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group of df in an order, numbered from one."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, *, filter_: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k most similar chunks of each query, ties by chunk_id.

    Scores are (1 + cosine) / 2, rounded. Chunks that fail filter_ are left out
    before ranking, so a filter never returns fewer rows than there are.
    """
    if filter_ is not None:
        chunks = chunks.where(filter_)

    def nearest(ids: np.ndarray, names: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((np.broadcast_to(names[:, 0], scores.shape), -scores), axis=1)[:, :k]
        return [np.repeat(ids, order.shape[1]), names[order, 0].ravel(), np.take_along_axis(scores, order, 1).ravel()]

    return best(_products(queries, chunks, ["chunk_id"], nearest, digits, k), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def best_chunks(queries: DataFrame, chunks: DataFrame, k: int | None = None, *, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, chunk_id, score, rank): the most similar chunk of each document, ties by chunk_id, for the k best documents of each query, or all.

    A pair of blocks gives a row per query and document, or for the k best of
    them: a document that isn't among the k best of the block with its best
    chunk isn't among them at all. For all documents there is nothing to leave out:
    a document's chunks stand together, and what a task finds of them is final.
    """
    if k is None:
        return _every_document(queries, chunks, digits).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))

    def nearest(ids: np.ndarray, names: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((names[:, 0], names[:, 1]))
        own, ordered = names[order], scores[:, order]
        first = np.flatnonzero(np.r_[True, own[1:, 1] != own[:-1, 1]])
        most = np.maximum.reduceat(ordered, first, axis=1)
        size = np.diff(np.r_[first, len(own)])
        at = np.minimum.reduceat(np.where(ordered == np.repeat(most, size, axis=1), np.arange(len(own)), len(own)), first, axis=1)
        docs = np.broadcast_to(own[first, 1], most.shape)
        chosen = np.lexsort((docs, -most), axis=1)[:, :k]
        take = lambda x: np.take_along_axis(x, chosen, 1).ravel()
        return [np.repeat(ids, chosen.shape[1]), own[take(at), 0], take(docs), take(most)]

    one = _best_of_pairs(_products(queries, chunks, ["chunk_id", "doc_id"], nearest, digits, k))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def _best_of_pairs(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_id, score): of the rows of a query and a document the one with the best score, ties by chunk_id."""
    first = F.max_by(F.struct("chunk_id", "score"), F.struct("score", (-F.col("chunk_id")).alias("t"))).alias("b")
    return rows.groupBy("query_id", "doc_id").agg(first).select("query_id", "doc_id", "b.*")


def _every_document(queries: DataFrame, chunks: DataFrame, digits: int) -> DataFrame:
    """(query_id, doc_id, chunk_id, score): the best chunk of each document for each query.

    Documents are dealt to blocks and queries to parts by hashes of their ids, and a
    task reads a block's chunks before the queries of a part, a few of which it
    scores at a time. Only documents of over LARGE chunks are split, and only their
    rows, and those of query ids that come repeatedly, meet again.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    own = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    times = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = lambda df, most: df.agg(F.coalesce(F.sum(F.when(F.col("n") <= most, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > most, F.col("n"))), F.lit(0))).first()
    (once, often), (whole, split) = counted(times, 1), counted(sizes, LARGE)
    single, small, met = asked, own, None
    if split:
        # at most one in LARGE of all chunks is a row of this
        large = F.broadcast(sizes.where(F.col("n") > LARGE).select(F.col("doc_id").alias("_id")))
        is_large = F.col("doc_id").eqNullSafe(F.col("_id"))
        small = own.join(large, is_large, "left_anti")
    if often:
        repeated = times.where("n > 1").select(F.col("query_id").alias("_id"))
        comes_again = F.col("query_id").eqNullSafe(F.col("_id"))
        single = asked.join(repeated, comes_again, "left_anti")
        met = _scored(asked.join(repeated, comes_again, "left_semi"), often, own, whole + split, ["chunk_id", "vec"], digits)
    if split:
        rows = _scored(single, once, own.join(large, is_large, "left_semi"), split, ["chunk_id", "vec"], digits)
        met = rows if met is None else met.unionByName(rows)
    final = _scored(single, once, small, whole, ["doc_id"], digits)
    return final if met is None else final.unionByName(_best_of_pairs(met))


def _scored(asked: DataFrame, n_asked: int, chunks: DataFrame, n: int, by: Sequence[str], digits: int) -> DataFrame:
    """(query_id, doc_id, chunk_id, score): the best chunk of each document that stands in a block, for each query and each block; by: what deals chunks to blocks."""
    n_blocks, n_parts = max(1, -(-n // CHUNK_BLOCK)), max(1, -(-n_asked // ASKED_ALL))
    each = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    dealt = lambda size, *of: F.pmod(F.xxhash64(*of), F.lit(size)).cast("int")
    kept = chunks.select(dealt(n_blocks, *by).alias("block"), each(n_parts).alias("part"), F.lit(False).alias("asks"), "doc_id", F.col("chunk_id").alias("id"), "vec")
    sent = asked.select(each(n_blocks).alias("block"), dealt(n_parts, "query_id", "vec").alias("part"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("doc_id"), F.col("query_id").alias("id"), "vec")
    rows = kept.unionByName(sent).repartition(min(n_blocks * n_parts, MOST_TASKS), "block", "part").sortWithinPartitions("block", "part", "asks", "doc_id", "id")
    return rows.mapInArrow(lambda batches: _best_in_blocks(batches, digits), "query_id long, doc_id long, chunk_id long, score double")


def _best_in_blocks(batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[pa.RecordBatch]:
    """Batches (query_id, doc_id, chunk_id, score) of batches (block, part, asks, doc_id, id, vec) in that order: in each block and part chunks come before queries. One block and a table of SCORES cells are held."""
    key, gathered, block = None, [], None
    for batch in batches:
        place = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("block", "part", "asks")])
        cuts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0), True]) if batch.num_rows else ()
        for lo, hi in pairwise(cuts):
            rows, now = batch.slice(lo, hi - lo), tuple(place[:2, lo])
            if not place[2, lo]:
                if now != key:
                    key, gathered, block = now, [], None
                gathered.append(rows)
            elif now == key:
                if block is None:
                    block, gathered = _documents(pa.Table.from_batches(gathered).combine_chunks()), []
                values, docs, chunks, first, vec = *block, rows.column("vec")
                asks, many = _floats(vec, max(_width(vec), values.shape[1]))[:, : values.shape[1]], max(1, SCORES // len(values))
                for at in range(0, len(asks), many):
                    scores = np.round((1 + asks[at : at + many] @ values.T) / 2, digits)
                    most = np.maximum.reduceat(scores, first, axis=1)
                    # the first of a document's chunks that reach its best score
                    hit = np.where(scores == np.repeat(most, np.diff(np.r_[first, len(values)]), axis=1), np.arange(len(values)), len(values))
                    best_at = np.minimum.reduceat(hit, first, axis=1)
                    ids = rows.column("id").slice(at, len(most)).take(pa.array(np.repeat(np.arange(len(most)), len(first))))
                    yield pa.RecordBatch.from_arrays([ids, docs.take(pa.array(np.tile(np.arange(len(first)), len(most)))), chunks.take(pa.array(best_at.ravel())), pa.array(most.ravel())], ["query_id", "doc_id", "chunk_id", "score"])


def _documents(rows: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Vectors of chunks in the order of their documents, the documents' ids, the chunks' ids, and each document's first place."""
    docs, chunks, vec = (rows.column(c).combine_chunks() for c in ("doc_id", "id", "vec"))
    own, none = np.asarray(docs.fill_null(0)), np.asarray(docs.is_null())
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (none[1:] != none[:-1])])
    return _floats(vec, _width(vec)), docs.take(pa.array(first)), chunks, first


def scored_documents(queries: DataFrame, chunks: DataFrame, *, digits: int = 6) -> Callable[[DataFrame], DataFrame]:
    """How rows (query_id, doc_id) become (query_id, chunk_id, doc_id, score) of the chunks of these documents alone, by joins on their keys."""
    named = chunks.select("doc_id", "chunk_id", F.col("vec").alias("_c"))
    asked = queries.select("query_id", F.col("vec").alias("_q"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.select("query_id", "doc_id").distinct().join(named, "doc_id").join(asked, "query_id")
        return met.select("query_id", "chunk_id", "doc_id", similarity(F.col("_q"), F.col("_c"), digits).alias("score"))

    return scored


def _floats(column: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter ones end in zeros."""
    length = np.asarray(column.value_lengths(), np.int64)
    if len(length) and (length == size).all():
        return np.asarray(column.flatten(), np.float64).reshape(-1, size)
    out = np.zeros((len(length), size))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = np.asarray(column.flatten(), np.float64)
    return out


def _width(*columns: pa.Array) -> int:
    return max((int(np.asarray(c.value_lengths()).max(initial=0)) for c in columns), default=0)


def _dealt(chunks: DataFrame, ids: Sequence[str], n: int) -> DataFrame:
    """(block, centre, radius, rows): chunks packed by the pivot they are nearest to; the pivots are chunks, the first by a hash of their id."""
    own = chunks.select(*(F.col(c).cast("long").alias(c) for c in ids), F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    pivots = own.orderBy(F.xxhash64(ids[0]), ids[0]).limit(min(PIVOTS, n // CHUNK_BLOCK)).toArrow().column("vec").combine_chunks() if n >= LEAST_DEALT else None

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = _width(batch.column("vec"), pivots)
            at = np.argmax(_floats(batch.column("vec"), size) @ _floats(pivots, size).T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "cell"])

    rows = own.withColumn("cell", F.lit(0)) if pivots is None else own.mapInArrow(cells, ", ".join(f"{c} long" for c in ids) + ", vec array<double>, cell int")
    # at most as many cells as pivots
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_BLOCK).cast("int").alias("parts"))
    named = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64(*ids), F.col("parts")).cast("int"))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        vec = table.column("vec").combine_chunks()
        values = _floats(vec, _width(vec))
        centre = values.mean(axis=0)
        radius = float(np.sqrt(((values - centre) ** 2).sum(axis=1).max()))
        names = np.stack([np.asarray(table.column(c)) for c in ids], axis=1)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "ids": pa.array([names.tobytes()], pa.binary()), "vecs": pa.array([values.tobytes()], pa.binary())})

    made = named.groupBy("cell", "part").applyInArrow(packed, "cell int, part int, centre array<double>, radius double, ids binary, vecs binary")
    return stored(made.select((F.shiftleft(F.col("cell").cast("long"), 32) + F.col("part")).alias("block"), "centre", "radius", "ids", "vecs"))


def _met(blocks: DataFrame, asked: DataFrame, ids: Sequence[str], keep: Callable, digits: int, n_queries: int) -> DataFrame:
    """(query_id, *ids, score): what keep(query ids, rows of chunk ids, scores) takes of each block for the asked(query_id, vec, block) that meet it."""
    n_parts = max(1, -(-n_queries // ASKED))
    sent = asked.select("block", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int").alias("part"), "query_id", "vec")
    kept = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "ids", "vecs")

    def scored(table: pa.Table) -> pa.Table:
        given = table.column("ids").is_valid()
        block, rows = table.filter(given), table.filter(pc.invert(given))
        out = []
        if block.num_rows and rows.num_rows:
            names = np.frombuffer(block.column("ids")[0].as_py(), np.int64).reshape(-1, len(ids))
            found = np.frombuffer(block.column("vecs")[0].as_py(), np.float64).reshape(len(names), -1)
            vec = rows.column("vec").combine_chunks()
            values = _floats(vec, max(_width(vec), found.shape[1]))[:, : found.shape[1]]
            asks = np.asarray(rows.column("query_id"))
            for lo in range(0, len(asks), 128):
                out.append(keep(asks[lo : lo + 128], names, np.round((1 + values[lo : lo + 128] @ found.T) / 2, digits)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * (1 + len(ids)) + [np.zeros(0)]
        return pa.table(dict(zip(["query_id", *ids, "score"], columns, strict=True)))

    return kept.unionByName(sent, allowMissingColumns=True).groupBy("block", "part").applyInArrow(scored, "query_id long, " + "".join(f"{c} long, " for c in ids) + "score double")


def _bounded(queries: DataFrame, centres: pa.Table, digits: int, *, all_of: bool) -> DataFrame:
    """queries with block: the one whose bound is greatest, or, if all_of, each whose bound reaches the query's least score, tau."""
    blocks, radii = np.asarray(centres.column("block")), np.asarray(centres.column("radius"))
    vec = centres.column("centre").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                size = _width(batch.column("vec"), vec)
                values = _floats(batch.column("vec"), size)
                norm = np.sqrt((values**2).sum(axis=1))
                # no chunk of a block is more like the query; a little room for floating point
                most = np.round((1 + values @ _floats(vec, size).T + norm[:, None] * radii) / 2 + 1e-9 * (1 + norm[:, None]) + 10.0**-digits, digits)
                row, at = np.nonzero(most >= np.asarray(batch.column("tau"))[:, None]) if all_of else (np.arange(len(most)), np.argmax(most, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), batch.column("vec").take(pa.array(row)), pa.array(blocks[at])], ["query_id", "vec", "block"])

    return queries.mapInArrow(run, "query_id long, vec array<double>, block long")


def _products(queries: DataFrame, chunks: DataFrame, ids: Sequence[str], keep: Callable, digits: int, k: int | None) -> DataFrame:
    """(query_id, *ids, score): what keep takes of each block of chunks for each query, for all blocks that can hold one of its k best (or all if k is None)."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    n_queries, n = asked.count(), chunks.where(F.col("vec").isNotNull()).count()
    blocks = _dealt(chunks, ids, n)
    if k is None or n < LEAST_DEALT or n // CHUNK_BLOCK > CENTRES:
        # as many numbers as there are blocks
        every = blocks.agg(F.collect_list("block").alias("all"))
        return _met(blocks, asked.crossJoin(F.broadcast(every)).select("query_id", "vec", F.explode("all").alias("block")), ids, keep, digits, n_queries)
    centres = blocks.select("block", "centre", "radius").toArrow()
    near = _met(blocks, _bounded(asked, centres, digits, all_of=False), ids, keep, digits, n_queries)
    least = near.groupBy("query_id").agg(F.min("score").alias("tau"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id", "tau")
    bounded = stored(asked.join(least, "query_id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("-inf")))))
    return _met(blocks, _bounded(bounded, centres, digits, all_of=True), ids, keep, digits, n_queries)


def small_to_big(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits with each leaf replaced by its parent, where parents(chunk_id, parent_id) has one; the best-ranked leaf of a parent stays.

    A kept child can name a dropped parent, so the join is a left one.
    """
    joined = hits.join(parents.select("chunk_id", "parent_id"), "chunk_id", "left").withColumn("returned_id", F.coalesce("parent_id", "chunk_id"))
    first = best(joined, ["query_id", "returned_id"], [F.asc("rank"), F.asc("chunk_id")], 1, "_n").drop("_n", "parent_id")
    return first.withColumnRenamed("chunk_id", "matched_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "matched_id")))


def quota(hits: DataFrame, quotas: dict[str, int], k: int) -> DataFrame:
    """K rows per query with the best quotas[c] of each category c reserved; the rest by rank; the order stays that of rank."""
    wanted = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in quotas.items()), F.lit(0))
    ranked = hits.withColumn("_c", F.row_number().over(Window.partitionBy("query_id", "category").orderBy("rank")))
    filled = ranked.withColumn("_fill", F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("_c") <= wanted).desc(), "rank"))).where(F.col("_fill") <= k)
    return filled.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("_c", "_fill")


def prefer(hits: DataFrame, priority: Column | Sequence[str]) -> DataFrame:
    """Hits reordered by the place of their category in a priority list, then by rank."""
    listed = priority if isinstance(priority, Column) else F.array(*(F.lit(c) for c in priority))
    place = F.coalesce(F.nullif(F.array_position(listed, F.col("category")), F.lit(0)), F.size(listed) + 1)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "rank")))


def merge_variants(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits of several variants (variant_pos) of a query as one list: first occurrence of each chunk, variants in order."""
    first = best(hits, ["query_id", key], [F.asc("variant_pos"), F.asc("rank")], 1, "_n").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("variant_pos", "rank", key)))


def parse_categories(raw: Column, vocabulary: Sequence[str] = CATEGORIES) -> Column:
    """a comma list as an array of known categories; an unknown one is an error."""
    given = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda c: F.lower(F.trim(c))), lambda c: c != ""))
    unknown = F.array_except(given, F.array(*(F.lit(c) for c in vocabulary)))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown categories: "), F.array_join(unknown, ", ")))).otherwise(given)


def route(queries: DataFrame, rules: Sequence[tuple] = ROUTES, text_col: str = "text") -> DataFrame:
    """Queries with rule, categories and mode of the first rule that has a keyword in the text, or nulls. The rules are part of the expression."""
    text = F.col(text_col)
    chosen = F.lit(None).cast("struct<rule:string,categories:array<string>,mode:string>")
    for name, keywords, categories, mode in reversed(rules):
        chosen = F.when(text.rlike(keyword_pattern(keywords)), F.struct(F.lit(name).alias("rule"), F.array(*(F.lit(c) for c in categories)).alias("categories"), F.lit(mode).alias("mode"))).otherwise(chosen)
    return queries.withColumn("_r", chosen).select("*", "_r.rule", "_r.categories", "_r.mode").drop("_r")


def expand_links(hits: DataFrame, links: DataFrame, scored: Callable[[DataFrame], DataFrame], *, hops: int = 1, max_expand: int = 5, contexts: Sequence[str] | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """The best leaf of each document that hit documents link to within hops, with linked_from; at most max_expand per query, then those already returned go.

    hits(query_id, chunk_id, doc_id), links(src, tgt, link_context, category of the
    target); scored gives the scores of the leaf chunks of rows (query_id, doc_id),
    as scored_documents does.
    """
    edges = links
    if contexts is not None:
        edges = edges.where(F.col("link_context").isin(*contexts))
    if categories is not None:
        edges = edges.where(F.col("category").isin(*categories))
    edges = edges.select(F.col("src").alias("doc_id"), "tgt").distinct()
    seeds = hits.select("query_id", "doc_id").distinct()
    frontier, seen, reached = seeds.withColumn("seed", F.col("doc_id")), seeds, None
    for _ in range(hops):
        step = frontier.join(edges, "doc_id").select("query_id", F.col("tgt").alias("doc_id"), "seed").distinct().join(seen, ["query_id", "doc_id"], "left_anti")
        reached = step if reached is None else reached.unionByName(step)
        frontier, seen = step, seen.unionByName(step.select("query_id", "doc_id")).distinct()
    targets = reached.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("seed")).alias("linked_from"))
    leaf = best(scored(targets).join(targets, ["query_id", "doc_id"]), ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_id")], 1, "_n").drop("_n")
    capped = best(leaf, ["query_id"], [F.desc("score"), F.asc("chunk_id")], max_expand)
    return capped.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def expand_ancestors(hits: DataFrame, ancestors: DataFrame, scored: Callable[[DataFrame], DataFrame], *, max_ancestors: int = 3) -> DataFrame:
    """For each query the nearest ancestors (root to nearest in ancestors.ancestor_ids) of its hits that it has not retrieved, first seen first, each with its best leaf."""
    lines = hits.join(ancestors, "doc_id").select("query_id", "rank", F.posexplode(F.reverse("ancestor_ids")).alias("pos", "ancestor"))
    own = hits.select("query_id", F.col("doc_id").alias("ancestor")).distinct()
    first = lines.join(own, ["query_id", "ancestor"], "left_anti").groupBy("query_id", "ancestor").agg(F.min(F.struct("rank", "pos")).alias("seen"))
    chosen = best(first, ["query_id"], [F.asc("seen"), F.asc("ancestor")], max_ancestors, "place").select("query_id", F.col("ancestor").alias("doc_id"), "place")
    return best(scored(chosen).join(chosen, ["query_id", "doc_id"]), ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_id")], 1, "_n").drop("_n").withColumnRenamed("place", "rank")


def additive(*parts: DataFrame) -> DataFrame:
    """Results put after one another by origin; a document already returned for the query isn't returned again."""
    out = None
    for pos, part in enumerate(parts):
        part = part.select("query_id", "chunk_id", "doc_id", "score", "rank", F.lit(pos).alias("origin_pos"))
        out = part if out is None else out.unionByName(part)
    first = best(out, ["query_id", "chunk_id"], [F.asc("origin_pos"), F.asc("rank")], 1, "_n").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("origin_pos", "rank", "chunk_id")))


def retrieve(queries: DataFrame, chunks: DataFrame, *, k: int = 10, oversample: int = 4, filter_: Column | None = None, quotas: dict[str, int] | None = None, merge: bool = True, always_oversample: bool = False, exact_filter: bool = True) -> DataFrame:
    """Top k per query with small-to-big merge, category filter and quota.

    The pool is k * oversample rows only if a filter or quota is set (or
    always_oversample); exact_filter filters before ranking, else the pool is
    filtered afterwards.
    """
    wide = always_oversample or filter_ is not None or bool(quotas)
    pool = vector_topk(queries, chunks, k * oversample if wide else k, filter_=filter_ if exact_filter else None)
    labels = chunks.select("chunk_id", "parent_id", "doc_id", "category")
    if filter_ is not None and not exact_filter:
        pool = pool.join(chunks.where(filter_).select("chunk_id"), "chunk_id", "left_semi")
    merged = small_to_big(pool, labels) if merge else pool.withColumn("matched_id", F.col("chunk_id")).withColumnRenamed("chunk_id", "returned_id")
    shaped = merged.join(labels.select(F.col("chunk_id").alias("matched_id"), "doc_id", "category"), "matched_id", "left").withColumn("category", F.coalesce("category", F.lit("other")))
    if quotas:
        return quota(shaped, quotas, k)
    return best(shaped, ["query_id"], [F.asc("rank")], k)


#: Properties of a hit's document, and what stands for a missing one.
PROVENANCE = {"source_url": "", "title": "", "category": "other", "doc_type": "", "audience": "", "site_topic": "", "source_type": "", "topic_path": "", "reference_number": "", "revision": ""}


def shaped(hits: DataFrame, docs: DataFrame, *, origin: str = "vector") -> DataFrame:
    """One flat row per hit(query_id, rank, score, returned_id, matched_id, doc_id, ...) with its document's properties, defaults for missing ones and for documents that aren't there, the origin of the hit and its place in the site tree."""
    has = lambda df, c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    own = docs.select("doc_id", *(has(docs, c, "string").cast("string").alias(f"_{c}") for c in PROVENANCE), has(docs, "depth", "int").cast("int").alias("depth"), has(docs, "parent_id", "string").cast("string").alias("parent_id"))
    rows = hits.join(own, "doc_id", "left")
    filled = [F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.lit(default)).alias(c) for c, default in PROVENANCE.items()]
    came = F.coalesce(has(hits, "origin", "string"), F.lit(origin)).alias("origin")
    return rows.select("query_id", "rank", "score", "returned_id", F.coalesce(has(hits, "matched_id", "long"), "returned_id").alias("matched_id"), "doc_id", came, *filled, "depth", "parent_id")


def steered(queries: DataFrame, chunks: DataFrame, *, k: int = 10, oversample: int = 4) -> DataFrame:
    """Retrieval for queries(query_id, text, vec, source_category): an explicit category, else the routing rule, steers each query.

    A filter that leaves a query without rows falls back to plain retrieval for
    that query; prefer reorders. notes says what was done.
    """
    plan = route(queries).withColumn("explicit", parse_categories(F.col("source_category")))
    plan = plan.withColumn("wanted", F.when(F.size("explicit") > 0, F.col("explicit")).otherwise(F.coalesce("categories", F.array().cast("array<string>"))))
    plan = plan.withColumn("mode", F.when(F.size("explicit") > 0, "filter").otherwise(F.coalesce("mode", F.lit("plain")))).select("query_id", "wanted", "mode")
    pool = retrieve(queries, chunks, k=k * oversample, merge=True).join(plan, "query_id")
    fitting = F.array_contains("wanted", F.col("category"))
    filtered = pool.where((F.col("mode") == "filter") & fitting)
    empty = plan.where("mode = 'filter'").join(filtered.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(True).alias("_empty"))
    joined = pool.join(empty, "query_id", "left").where((F.col("mode") != "filter") | fitting | F.col("_empty"))
    note = F.when(F.col("_empty"), "filter was empty, unfiltered").when(F.col("mode") == "filter", "filtered").when(F.col("mode") == "prefer", "preferred").otherwise("")
    place = F.when(F.col("mode") == "prefer", F.coalesce(F.nullif(F.array_position("wanted", F.col("category")), F.lit(0)), F.size("wanted") + 1)).otherwise(F.lit(0))
    ranked = best(joined, ["query_id"], [F.asc("rank")], k, "_n").drop("_n")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "rank"))).withColumn("notes", note).drop("_empty", "wanted", "mode")


def similar_queries(queries: DataFrame, cache: DataFrame, *, k: int = 3, threshold: float = 0.88, min_rating: float | None = None) -> DataFrame:
    """The k past queries of cache(run_id, vec, rating) nearest to each query: of the 3k nearest, those with cosine over threshold and a rating not under min_rating."""
    near = vector_topk(queries, cache.select(F.col("run_id").alias("chunk_id"), "vec"), 3 * k).withColumn("cosine", F.round(2 * F.col("score") - 1, 6))
    joined = near.join(cache.select(F.col("run_id").alias("chunk_id"), "rating"), "chunk_id").where(F.col("cosine") >= threshold)
    if min_rating is not None:
        joined = joined.where(F.col("rating") >= min_rating)
    return best(joined, ["query_id"], [F.asc("rank")], k).withColumnRenamed("chunk_id", "run_id")


def few_shots(similar: DataFrame, cache: DataFrame, *, min_examples: int = 2) -> DataFrame:
    """(query_id, examples): the block of past questions and answers of each query that has at least min_examples."""
    counted = similar.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where(F.col("_n") >= min_examples)
    lines = counted.join(cache.select("run_id", "question_text", "answer_summary"), "run_id").select("query_id", "rank", F.concat(F.lit("Q: "), F.col("question_text"), F.lit("\nA: "), F.col("answer_summary")).alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("examples"))


def apply_processors(df: DataFrame, processors: Sequence) -> DataFrame:
    """Post-processors (DataFrame to DataFrame) in order."""
    for p in processors:
        df = df.transform(p)
    return df


def keyword_scope(chunks: DataFrame, docs: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """all chunks of the documents in whose title or chunks a keyword stands."""
    pattern = keyword_pattern(keywords)
    hit = docs.where(F.coalesce(F.col("title").rlike(pattern), F.lit(False))).select("doc_id").unionByName(chunks.where(F.col("text").rlike(pattern)).select("doc_id")).distinct()
    return chunks.join(hit, "doc_id", "left_semi")


def reusable(cache: DataFrame) -> DataFrame:
    """past answers that may be used again: unrated or rated 4 and up."""
    return cache.where(F.col("rating").isNull() | (F.col("rating") >= 4))


def leaves(chunks: DataFrame) -> DataFrame:
    """leaf chunks with text."""
    return chunks.where(F.col("is_leaf") & (F.trim("text") != ""))


def with_concept(df: DataFrame, concept: str) -> DataFrame:
    """rows tagged with a concept."""
    return df.where(F.array_contains("concepts", concept))
