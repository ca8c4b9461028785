"""Near duplicates by MinHash bands and odd sketches.

A document's set of word shingles gives MinHash samples. Bands of them put nearly
all pairs of similar sets under a common key; the same samples are folded into a
bitmap that holds, bit by bit, the parity of how many samples fall there. Of two
sets the bitmaps differ in places of samples that only one has, so the number of
ones of their XOR tells how many samples differ, most precisely where few do.
Pairs under a key whose bitmaps are near get an exact check on their full sets.
A second bitmap holds the parities of the full set: its XOR has at most as many
ones as the sets differ in members, which rules out pairs for certain.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined_by_weight, parts, plain_docs, written
from .near_links import SET_BITS, connected, ones, parities, shingled
from .simhash_golay import shingle_sets

#: Words of a shingle, and the similarity of linked sets.
SHINGLE_WORDS, SIMILAR = 4, 0.8
#: Bands and samples of a band: two sets of 0.8 share no band once in 1.4e9 pairs. Bits of an odd sketch.
BANDS, ROWS, BITS = 40, 4, 512
#: Standard deviations by which a pair of similarity 0.8 may differ in more bits than expected.
SIGMAS = 6.0
#: Hashes that are sampled at once, and bytes of a set's size and bitmaps.
PIECE, WIDTH = 8192, 8 + BITS // 8 + SET_BITS // 8


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the permutations of 32-bit hashes, by a rule."""
    x = np.array([xxhash.xxh64_intdigest(b"sample", i) for i in range(BANDS * ROWS)], np.uint64)
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] | np.uint32(1), (x >> np.uint64(32)).astype(np.uint32)[:, None]


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set's hashes under each permutation; of an empty set the greatest number."""
    times, plus = _multipliers()
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(short), PIECE):
        out = np.minimum(out, (short[None, lo : lo + PIECE] * times + plus).min(axis=1))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, bitmaps) of rows of samples: a key for each band, and the parities of samples by place."""
    n = len(values)
    of = np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32)
    mixed = _mixed((values.astype(np.uint64) | of[None, :]) + np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((n, BANDS), np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys ^ mixed[:, k::ROWS])
    place = (mixed >> np.uint64(32)).astype(np.int64) % BITS + np.arange(n)[:, None] * BITS
    parity = np.bincount(place.ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return keys.view(np.int64), np.packbits(parity.astype(bool), axis=1)


def differing(similarity: float) -> tuple[float, float]:
    """Expected number of ones, and its standard deviation, of the XOR of two sets' bitmaps."""
    n = BANDS * ROWS
    apart, of_samples = 2 * n * (1 - similarity), 2 * math.sqrt(n * similarity * (1 - similarity))
    ones = BITS / 2 * (1 - math.exp(-2 * apart / BITS))
    # samples that happen to differ, and places where some of these meet
    return ones, math.hypot(of_samples * math.exp(-2 * apart / BITS), math.sqrt(BITS / 4 * (1 - math.exp(-4 * apart / BITS))))


def similarity(ones: np.ndarray) -> np.ndarray:
    """The estimate of two sets' Jaccard similarity from the ones of their bitmaps' XOR."""
    apart = -BITS / 2 * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(ones) / BITS))
    return np.maximum(0.0, 1 - apart / (2 * BANDS * ROWS))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places of their samples' bitmaps rows differ."""
    return ones(x, y, 8, 8 + BITS // 8)


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of sizes and bitmaps may be of sets that are similar."""
    expected, off = differing(SIMILAR)
    a, b = (np.ascontiguousarray(v[:, :8]).view(np.int64).ravel() for v in (x, y))
    good = np.flatnonzero(100 * np.minimum(a, b) >= round(100 * SIMILAR) * np.maximum(a, b))
    good = good[apart(x[good], y[good]) <= expected + SIGMAS * off]
    # similar sets differ in a ninth of their members together at most
    good = good[9 * ones(x[good], y[good], 8 + BITS // 8, WIDTH) <= a[good] + b[good]]
    out = np.zeros(len(x), bool)
    out[good] = True
    return out


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, hash, node, n_shingles, bands, data) of docs(doc_id, text, hash): node names the set of shingles, data holds its size and bitmap."""

    def run(batches):
        for batch in parts(batches, 2000):
            sets = shingle_sets(batch.column("text"), words)
            size = np.array(list(map(len, sets)), np.int64)
            keys, bitmaps = sketches(np.array([samples(h) for h in sets], np.uint32).reshape(-1, BANDS * ROWS))
            data = np.concatenate([size[:, None].view(np.uint8), bitmaps, np.array([parities(h) for h in sets], np.uint8).reshape(-1, SET_BITS // 8)], axis=1)
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(node), pa.array(size), lists, pa.array([r.tobytes() for r in data], pa.binary())], ["doc_id", "hash", "node", "n_shingles", "bands", "data"])

    return docs.mapInArrow(run, "doc_id long, hash long, node long, n_shingles long, bands array<long>, data binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Rows are linked if the Jaccard similarity of their sets of shingles is 0.8 or
    more; component_id is the smallest doc_id reachable, kept says that it is the
    row's own. A text without words, an empty or null one has no shingle, and its
    component is its own id. Repeated rows each come back; a null id is no
    component's number unless all of its ids are null.
    """
    plain = plain_docs(docs, id_col=id_col, text_col=text_col).withColumn("hash", F.xxhash64("text"))
    found = written(sketched(plain, words))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("x")
    own = written(found.where("n_shingles > 0").groupBy("node").agg(one, F.first("bands").alias("bands"), F.first("data").alias("data")).select("node", "x.doc_id", "x.hash", "bands", "data"))
    rows = own.select(F.explode("bands").alias("key"), "node")
    shared = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1"))
    met = written(joined_by_weight(rows, shared, ["key"]).select("key", "node", "lead"))

    data, nodes = own.select("node", "data"), met.select("node").distinct()
    sets = written(shingled(plain, own.join(nodes, "node", "left_semi"), lambda texts: shingle_sets(texts, words)))
    # first each with the least of its key
    least = met.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    linked = connected(met.select("key", "node"), least, data, sets, near, WIDTH, apart)
    ids = own.select("node", "doc_id").join(linked, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    named = ids.join(ids.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "node", "n_shingles").join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
