"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are grams of character classes, hashed words, and how much a text repeats
its words. A truncated SVD over the terms of a bounded, hash-ordered sample of
labelled documents gives the latent space; the sample's labelled vectors are
broadcast (``sample`` x ``dims`` floats, whatever the input), every document's
cosine to all of them is computed exactly in blocks, and its nearest neighbours'
labels vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import boxed, flat, lean, plain_docs, slices, unboxed

SAMPLE, DIMS, NEIGHBOURS, SHARPNESS, ACCEPT, BLOCK = 4000, 40, 15, 4.0, 0.3, 512
WORD_DIMS, REPEAT_DIMS, CLASSES = 512, 24, 13
GRAM_DIMS = CLASSES**3
TERMS = GRAM_DIMS + WORD_DIMS + REPEAT_DIMS


def _classes() -> np.ndarray:
    """A class for each byte: letter case, digit, blank, line, common marks, other marks, parts of a longer character."""
    out = np.full(256, 9, np.uint8)
    for kind, low, high in ((0, 97, 123), (1, 65, 91), (2, 48, 58), (12, 128, 160), (11, 160, 192), (10, 192, 256)):
        out[low:high] = kind
    for kind, letter in ((3, 32), (4, 10), (5, 46), (6, 44), (7, 33), (8, 124)):
        out[letter] = kind
    return out


_CLASS_OF = _classes()


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log term counts of n texts laid end to end: an n x TERMS matrix of floats, each family scaled to length one."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS_OF[data].astype(np.int64)
    if len(data) > 2:
        gram = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        own = row[:-2] == row[2:]
        out[:, :GRAM_DIMS] = np.bincount(row[:-2][own] * GRAM_DIMS + gram[own], minlength=n * GRAM_DIMS).reshape(n, GRAM_DIMS)
    blank = (kind == 3) | (kind == 4)
    first = ~blank & np.r_[True, blank[:-1] | (row[1:] != row[:-1])]
    if first.any():
        starts = np.flatnonzero(first)
        # a polynomial in each byte's place in its word, summed per word
        place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
        mixed = np.where(blank, 0, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255])
        word = np.add.reduceat(mixed, starts)
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        at = row[starts]
        slot = (word >> np.uint64(40)).astype(np.int64) % WORD_DIMS
        out[:, GRAM_DIMS : GRAM_DIMS + WORD_DIMS] = np.bincount(at * WORD_DIMS + slot, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
        count = np.bincount(at, minlength=n)
        again = np.bincount(at[1:][(word[1:] == word[:-1]) & (at[1:] == at[:-1])], minlength=n)
        order = np.lexsort((word, at))
        fresh = np.r_[True, (word[order][1:] != word[order][:-1]) | (at[order][1:] != at[order][:-1])]
        distinct = np.bincount(at[order][fresh], minlength=n)
        some = np.maximum(count, 1)
        for base, share in ((0, again / some), (8, distinct / some), (16, np.minimum(count, 127) / 128)):
            slots = np.minimum((share * 8).astype(int), 7)
            out[np.arange(n), GRAM_DIMS + WORD_DIMS + base + slots] = count > 0
    np.log1p(out, out=out)
    for low, high, weight in ((0, GRAM_DIMS, 1.0), (GRAM_DIMS, GRAM_DIMS + WORD_DIMS, 0.4), (GRAM_DIMS + WORD_DIMS, TERMS, 0.5)):
        part = out[:, low:high]
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return out


_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


def fit(matrix: np.ndarray, dims: int = DIMS, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(inverse document frequencies, latent basis TERMS x dims) by subspace iteration from a fixed start."""
    held = (matrix > 0).sum(axis=0)
    idf = np.log((1 + len(matrix)) / (1 + held)).astype(np.float32) + 0.3
    weighted = matrix * idf
    start = np.random.default_rng(42).standard_normal((TERMS, dims + 8)).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    turn = np.linalg.svd(weighted @ basis, full_matrices=False)[2]
    return idf, (basis @ turn.T)[:, :dims].astype(np.float32)


def latent(matrix: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = (matrix * idf) @ basis
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Each vector's similarity-weighted share of label 1 among its k nearest known vectors, by exact cosine products; a zero vector gets the share among all."""
    k = min(k, len(known))
    cosine = vectors @ known.T
    near = np.argpartition(cosine, len(known) - k, axis=1)[:, len(known) - k :]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** SHARPNESS
    out = (weight * labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.where(np.abs(vectors).max(axis=1) > 0, out, labels.mean())


def _term_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                packed = [r.tobytes() for r in terms(*flat(part.column("text"))).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), part.column("quality")], ["terms", "quality"])

    return docs.select("text", "quality").mapInArrow(lean(run), "terms binary, quality int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """docs with held_out, score and predicted added (in place of columns of these names).

    The voters are at most ``sample`` labelled documents (those of the smallest
    xxhash64 of their id) whose crc32(id as text) mod 5 is not 0; the bound is
    part of the method and the only place where it samples. Of several labels of
    one document the highest counts; null labels and ids are passed over. Null
    and empty texts have a score too: their vector is zero and all voters have an equal say.
    Without any usable label every score is 0.5.
    """
    new = {"held_out": held_out(F.col("box").getField(id_col)), "score": F.col("score"), "predicted": (F.col("score") >= accept).cast("int")}
    return unboxed(_scored(docs, labels, id_col, text_col, sample), docs, new)


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs whose score is accept or more, with docs' own columns, whatever their names."""
    return unboxed(_scored(docs, labels, id_col, text_col, sample).where(F.col("score") >= accept), docs)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(box, score) for each row of docs."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    voters = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = plain_docs(docs, id_col=id_col, text_col=text_col)
    sampled = texts.join(F.broadcast(voters), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = _term_rows(sampled).toArrow()
    marks = np.array(found.column("quality").to_pylist(), np.float32)
    matrix = np.frombuffer(b"".join(found.column("terms").to_pylist()), np.float16).reshape(len(marks), TERMS).astype(np.float32)
    # rows come back in any order
    order = np.lexsort((matrix @ np.arange(TERMS, dtype=np.float32), marks))
    model = None
    if len(marks):
        matrix, marks = matrix[order], marks[order]
        idf, basis = fit(matrix)
        model = spark.sparkContext.broadcast((idf, basis, latent(matrix, idf, basis), marks))
    own, text_at = boxed(docs), docs.columns.index(text_col)
    schema = StructType([*own.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0).field(text_at))
            out = np.full(batch.num_rows, 0.5)
            for lo, hi in ((a, b) for x, y in slices(offsets, 1 << 20) for a, b in ((z, min(z + BLOCK, y)) for z in range(x, y, BLOCK))):
                if model is not None:
                    idf, basis, vectors, own = model.value
                    out[lo:hi] = vote(latent(terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), idf, basis), vectors, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["box", "score"])

    return own.mapInArrow(lean(run), schema)
