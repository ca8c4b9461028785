"""Links between sets of shingles: pairs checked where their data meet, and pairs across components of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined_by_weight, lean, parts, written
from .graphs import components

#: Parts that the pairs of one end are dealt to, rows of a bucket that are compared with each other at once, and rows of buckets compared by shifts.
PARTS, BLOCK, SMALL = 64, 2048, 8
#: Bits of the parities of a full set.
SET_BITS = 1024


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parities of a set's hashes by place."""
    return np.packbits(np.bincount(((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SET_BITS, minlength=SET_BITS).astype(np.uint8) & 1)


def ones(x: np.ndarray, y: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """In how many bits of their bytes lo to hi rows differ."""
    words = (np.ascontiguousarray(v[:, lo:hi]).view(np.uint64) for v in (x, y))
    return np.bitwise_count(np.bitwise_xor(*words)).sum(axis=1, dtype=np.int64)


def checked(pairs: DataFrame, data: DataFrame, check: Callable[[bytes, list[bytes]], np.ndarray]) -> DataFrame:
    """The distinct pairs(a, b) whose data(node, data) pass check(of b, of several a).

    The pairs of an end b are dealt to PARTS parts, each with a copy of b's data;
    those of a travel once for each pair and stream past it.
    """
    parts = pairs.distinct().withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int"))
    need = parts.select("b", "part", F.col("a").alias("node"), F.lit(True).alias("other")).unionByName(parts.select("b", "part", F.col("b").alias("node"), F.lit(False).alias("other")).distinct())
    dealt = need.join(data, "node").select("b", "part", "other", "node", "data").repartition("b", "part").sortWithinPartitions("b", "part", "other")

    def run(batches):
        held = None
        for batch in batches:
            b, part, other, node = (np.asarray(batch.column(c)) for c in ("b", "part", "other", "node"))
            blobs = batch.column("data")
            start = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (part[1:] != part[:-1])][: len(b)])
            left, right = [], []
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(b)], strict=True):
                if not other[lo]:
                    held, lo = blobs[lo].as_py(), lo + 1
                if lo < hi:
                    good = np.flatnonzero(check(held, blobs.slice(lo, hi - lo).to_pylist())) + lo
                    left += node[good].tolist()
                    right += b[good].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right)], ["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def shingled(docs: DataFrame, wanted: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """(node, data) for each row of wanted(node, doc_id, hash): the set of its text, one of docs(doc_id, text, hash)."""

    def run(batches):
        for batch in parts(batches, 2000):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([h.tobytes() for h in sets_of(batch.column("text"))], pa.binary())], ["node", "data"])

    names = wanted.select("node", F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    texts = docs.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    # rows repeated with their id have equal texts
    return texts.select("node", "text").mapInArrow(lean(run), "node long, data binary").dropDuplicates(["node"])


def alike(own: bytes, others: list[bytes]) -> np.ndarray:
    """Which sets of hashes have a Jaccard similarity of 0.8 or more to one."""
    x = np.frombuffer(own, np.uint64)
    out = np.zeros(len(others), bool)
    for i, blob in enumerate(others):
        n = len(blob) // 8
        # of the shared ones there are at most as many as the smaller set has
        if 5 * min(n, len(x)) >= 4 * max(n, len(x)):
            out[i] = 9 * len(np.intersect1d(x, np.frombuffer(blob, np.uint64), assume_unique=True)) >= 4 * (n + len(x))
    return out


def connected(met: DataFrame, first: DataFrame, data: DataFrame, sets: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(node, root) of the nodes that links connect: links are pairs which share a key, are near and have sets alike.

    met(key, node) are the nodes of keys, data(node, data) what near and apart
    compare, sets(node, data) what is checked in the end. Pairs are checked in
    rounds: those of first(a, b), a over b; then, between nodes that aren't known to
    be connected, each with the one it is least apart from, in an eighth of the
    keys, or, without apart, with the one that most are near to, in each key; at
    last all pairs. So a class that some member is alike to most of gives few pairs,
    whatever its size.
    """
    done = cut(checked(first, data, _near_one(near, width)))
    links = cut(checked(done, sets, alike))
    for one in ("hub" if apart is None else apart, None):
        classed = met.join(_labels(links), "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
        some = classed.where("key & 7 = 0") if callable(one) else classed
        mixed = some.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("greatest")).where("least <> greatest").select("key")
        rows = written(some.join(mixed, "key").join(data, "node"))
        pairs = cut(across(rows, near, width, one).join(done, ["a", "b"], "left_anti"))
        links = cut(links.unionByName(checked(pairs, sets, alike)))
        done = done.unionByName(pairs)
    return components(links)


def _labels(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links: those of one label are connected, and those around one node have one label."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    return both.join(least.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.least("node", F.min("least")).alias("label"))


def _near_one(near: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> Callable[[bytes, list[bytes]], np.ndarray]:
    def check(own: bytes, others: list[bytes]) -> np.ndarray:
        y = np.frombuffer(b"".join(others), np.uint8).reshape(-1, width)
        return near(np.repeat(np.frombuffer(own, np.uint8)[None], len(y), axis=0), y)

    return check


def across(rows: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, one: Callable[[np.ndarray, np.ndarray], np.ndarray] | str | None = None) -> DataFrame:
    """The distinct pairs (a, b), a over b, of nodes that share a key but no component and are near; rows(key, node, comp, data).

    If one is given, a node of a larger key has only one pair in each block that it
    meets: that which is least apart by this function, or, for "hub", that with the
    row which most of those meeting the block are near to.

    Of a key's rows those outside its largest component, the odd ones, meet all
    others; blocks of odd rows meet blocks of rows, so a large component beside few
    odd rows costs as many comparisons as rows. near compares arrays of data, width
    bytes each, row by row. rows is read three times.
    """
    counts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    by_size = F.struct("n", F.negative("comp"))
    keys = cut(counts.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("comp", by_size).alias("main"), F.max("n").alias("most")).where("n > most"))
    placed = joined_by_weight(rows, keys, ["key"])
    n_rows, n_odd = (F.ceil(x / BLOCK).cast("int") for x in (F.col("n"), F.col("n") - F.col("most")))
    salt = F.xxhash64("node", "key")
    each = placed.select("key", "node", "comp", "data", (F.col("comp") != F.col("main")).alias("odd"), F.pmod(salt, n_rows).cast("int").alias("i"), F.pmod(salt, n_odd).cast("int").alias("j"), n_rows.alias("n_rows"), n_odd.alias("n_odd"))
    own = each.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_odd") - 1)))
    odd = each.where("odd").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    # an odd row is itself among the rows of one of its blocks
    columns = ("key", "i", "j", "node", "comp", "data")
    dealt = own.select(*columns, F.lit(False).alias("asks")).unionByName(odd.select(*columns, F.lit(True).alias("asks"))).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(group: np.ndarray, node: np.ndarray, comp: np.ndarray, asks: np.ndarray, data: np.ndarray):
        """Pairs in whole groups of rows."""
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        size = np.diff(np.r_[start, len(group)])
        small = np.repeat(size <= SMALL, size)
        left, right = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]) & (comp[step:] != comp[:-step]) & (asks[step:] != asks[:-step]))
            at = at[near(data[at], data[at + step])]
            left.append(node[at])
            right.append(node[at + step])
        for lo, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            own, who = (lo + np.flatnonzero(asks[lo : lo + n] == x) for x in (False, True))
            near_to = np.zeros((len(who), len(own)), bool) if one == "hub" else None
            for n_x, x in enumerate(who.tolist()):
                mine = np.flatnonzero(comp[own] != comp[x])
                at = own[mine]
                good = near(data[at], np.repeat(data[x : x + 1], len(at), axis=0))
                if near_to is not None:
                    near_to[n_x, mine] = good
                    continue
                at = at[good]
                if one is not None and len(at) > 1:
                    at = at[[np.lexsort((node[at], one(data[at], np.repeat(data[x : x + 1], len(at), axis=0))))[0]]]
                left.append(np.full(len(at), node[x]))
                right.append(node[at])
            if near_to is not None and near_to.size:
                by_most = np.lexsort((node[own], -near_to.sum(axis=0)))
                hub = by_most[np.argmax(near_to[:, by_most], axis=1)]
                has = near_to.any(axis=1)
                left.append(node[who[has]])
                right.append(node[own[hub[has]]])
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (left, right))
        both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in both.T], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8).reshape(-1, width)
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "i", "j")], axis=1)
            now = [key, *(np.asarray(batch.column(c)) for c in ("node", "comp")), np.asarray(batch.column("asks")), data]
            if held is not None:
                now = [np.concatenate(c) for c in zip(held, now, strict=True)]
            group = np.cumsum(np.r_[False, (now[0][1:] != now[0][:-1]).any(axis=1)])
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield pairs(group[:last], *(c[:last] for c in now[1:]))
            held = [c[last:] for c in now]
        if held is not None:
            yield pairs(np.zeros(len(held[0]), np.int64), *held[1:])

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()
