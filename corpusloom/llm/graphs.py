"""Connected components over an edge table of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, passing_shuffles


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the least node reachable.

    Alternating large-star and small-star rounds. Each round regroups edges by
    one end, keeps only the minimum per node as aggregation state and stores the
    new edges in the shared checkpoint folder; a hub's edges stay separate rows.
    Self-loops and repeated edges are ignored; an empty table gives no rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(linked.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _state(edges: DataFrame) -> tuple:
    with passing_shuffles(edges.sparkSession):
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
