"""Document fingerprints from locally consistent parsing.

Bytes are the phrases of level zero. Deterministic coin tossing turns a level's
phrase names into labels of three values, so that neighbours differ and a label
depends on a few neighbours only; local maxima start the next level's phrases,
whose names are hashes of the names they hold. Equal substrings are therefore
cut into equal phrases, up to a few at their ends, at whatever offset they stand.
A fingerprint keeps, for each of 64 bins, 16 bits of the least name that falls
into it among the phrases of the upper levels, so that the share of equal bins
estimates the share of phrases two texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_docs, slices

BINS, KEPT_FROM, BLOCK_BYTES, BUCKET_ROWS, MOST_BUCKETS = 64, 2, 1 << 20, 1024, 65_536
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tosses() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the coin toss: label of a value below 256 after another; and of one below 16 after another."""
    def table(n: int) -> np.ndarray:
        own, before = np.arange(n)[None, :], np.arange(n)[:, None]
        apart = own ^ before
        place = np.bitwise_count((apart & -apart) - 1)
        return np.where(apart == 0, 0, 2 * place + (own >> np.minimum(place, 62) & 1)).astype(np.uint8)

    return table(256).ravel(), table(16).ravel()


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 2 of names, no two neighbours of one text alike unless their names are; first marks where texts start."""
    wide, narrow = _tosses()
    if names.dtype == np.uint8:
        label = np.empty(len(names), np.uint8)
        label[0], label[1:] = 0, wide[(names[:-1].astype(np.uint16) << 8) | names[1:]]
        label[first] = names[first] & 1
    else:
        apart = names[1:] ^ names[:-1]
        place = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        label = np.empty(len(names), np.uint8)
        label[0], label[1:] = 0, np.where(apart == 0, 0, (place << np.uint64(1)) | (names[1:] >> np.minimum(place, np.uint64(63)) & np.uint64(1)))
        label[first] = names[first].astype(np.uint8) & 1
        tossed = np.empty(len(names), np.uint8)
        tossed[0], tossed[1:] = 0, wide[(label[:-1].astype(np.uint16) << 8) | label[1:]]
        tossed[first] = label[first] & 1
        label = tossed
    for _ in range(2):  # below 16, then below 8, then below 6
        tossed = np.empty_like(label)
        tossed[0], tossed[1:] = 0, narrow[(label[:-1] << 4) | label[1:]]
        tossed[first] = label[first] & 1
        label = tossed
    # the labels 3, 4 and 5 take the least value that neither neighbour has
    for value in (5, 4, 3):
        at = np.flatnonzero(label == value)
        if len(at):
            left = np.where(first[at], 9, label[np.maximum(at - 1, 0)])
            after = np.minimum(at + 1, len(label) - 1)
            right = np.where((at + 1 >= len(label)) | first[after], 9, label[after])
            label[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    return label


def parse(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, text numbers) of the phrases of each level from one on, for texts laid end to end; a text ends at the level where it is one phrase."""
    out, names = [], data
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    while len(names):
        first = np.r_[True, row[1:] != row[:-1]]
        # a run of one name is one symbol: its name and length
        fresh = first | np.r_[True, names[1:] != names[:-1]]
        starts = np.flatnonzero(fresh)
        symbols, owner, runs = names[starts], row[starts], np.diff(np.r_[starts, len(names)])
        head = first[starts]
        label = _labels(symbols, head)
        # a phrase starts at a text's start and at each local maximum, but not right after another start
        higher = np.empty(len(label), bool)
        higher[0], higher[1:] = True, label[1:] > label[:-1]
        peak = higher.copy()
        peak[:-1] &= (label[:-1] >= label[1:]) | head[1:]
        start = head | peak
        start[1:] &= ~head[:-1] | head[1:]
        at = np.flatnonzero(start)
        value = _mix(symbols.astype(np.uint64) + np.uint64((1 + len(out)) * int(_M1) & (1 << 64) - 1))
        several = runs > 1
        value[several] = _mix(value[several] ^ (runs[several].astype(np.uint64) * _M3))
        size = np.diff(np.r_[at, len(symbols)])
        place = (np.arange(len(symbols)) - np.repeat(at, size)).astype(np.uint64)
        names = _mix(np.add.reduceat(value * (np.uint64(2) * place + np.uint64(1)) + place, at) + size.astype(np.uint64))
        row = owner[at]
        out.append((names, row))
        more = np.bincount(row, minlength=1)[row] > 1
        names, row = names[more], row[more]
    return out


def sketch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x BINS 16-bit fingerprints of n texts laid end to end; zero marks an empty bin, so an empty text has zeros only."""
    n = len(offsets) - 1
    least = np.full(n * BINS, np.iinfo(np.uint64).max)
    levels = parse(data, offsets)
    top = np.zeros(n, np.int64)
    for level, (_, row) in enumerate(levels):
        top[row] = level
    for level, (names, row) in enumerate(levels):
        # a short text lacks upper levels: its last three count instead
        keep = level >= np.minimum(KEPT_FROM, np.maximum(top - 2, 0))[row]
        names, row = names[keep], row[keep]
        if len(names):
            name = _mix(names ^ _M1)
            slot = row * BINS + (name >> np.uint64(58)).astype(np.int64)
            order = np.lexsort((name, slot))
            head = np.r_[True, slot[order][1:] != slot[order][:-1]]
            at = order[head]
            least[slot[at]] = np.minimum(least[slot[at]], name[at] << np.uint64(6))
    bits = (least >> np.uint64(6) & np.uint64(0xFFFF)).astype(np.uint16)
    bits = np.where(least == np.iinfo(np.uint64).max, 0, np.maximum(bits, 1))
    return bits.reshape(n, BINS).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins filled in either fingerprint that are equal in both; 1 for two empty texts."""
    filled = (a != 0) | (b != 0)
    return np.where(filled.any(axis=1), ((a == b) & filled).sum(axis=1) / np.maximum(filled.sum(axis=1), 1), 1.0)


def hexed(prints: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in prints.astype(">u2")]


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])


def sketches(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts, in blocks of bounded size."""
    data, offsets = _packed(texts)
    parts = [sketch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, BLOCK_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint16)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row per row of docs. A null text counts as empty; equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hexed(sketches(batch.column(1).to_pylist())), pa.string())], ["doc_id", "fingerprint"])

    return plain_docs(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the start of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by ascending id.

    Ids are cut into buckets at quantiles, which are ids themselves (8 bytes for
    each of at most MOST_BUCKETS); a task adds to each bucket a copy of the next
    bucket's first document, so one shuffle of compressed texts brings all
    neighbours together, and a bucket is read as a stream from its greatest id
    down, of which only the last document met is held. After the last document comes the first. Rows that share an id have
    the same next document, the one with the next greater id (of several rows with
    it, the one whose text compresses most); rows without an id come first and count as smaller than any id.
    """
    least = np.iinfo(np.int64).min
    keyed = plain_docs(docs, id_col=id_col, text_col=text_col).withColumn("key", F.coalesce("doc_id", F.lit(least)))
    total, first = keyed.agg(F.count(F.lit(1)), F.min("key")).first()
    buckets = min(MOST_BUCKETS, max(1, total // BUCKET_ROWS))
    found = keyed.agg(F.percentile_approx("key", [i / buckets for i in range(buckets)], 10 * buckets)).first()[0] or []
    bounds = np.unique(np.array([first, *found] if total else [], np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            bucket = np.searchsorted(bounds, keys, side="right") - 1
            packed = [small(t.encode()) for t in batch.column("text").to_pylist()]
            blobs = pa.array(packed, pa.binary())
            # of a batch's rows with a bound's id one can be the first document
            heads = np.flatnonzero(bounds[np.maximum(bucket, 0)] == keys)
            best: dict[int, int] = {}
            for i in heads.tolist():
                at = best.setdefault(int(keys[i]), i)
                if (len(packed[i]), packed[i]) < (len(packed[at]), packed[at]):
                    best[int(keys[i])] = i
            heads = np.array(list(best.values()), np.int64)
            take = np.r_[np.arange(len(keys)), heads]
            target = np.r_[bucket, (bucket[heads] - 1) % max(1, len(bounds))]
            copy = np.r_[np.zeros(len(keys), bool), np.ones(len(heads), bool)]
            picked = pa.array(take)
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), pa.array(copy), batch.column("doc_id").take(picked), batch.column("key").take(picked), blobs.take(picked)], ["bucket", "copy", "doc_id", "key", "blob"])

    dealt = keyed.mapInArrow(deal, "bucket long, copy boolean, doc_id long, key long, blob binary")
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    order = ("bucket", F.desc("copy"), F.desc("key"), F.desc(F.length("blob")), F.desc("blob"))
    return dealt.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_stream, out)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, copies of the next bucket's first document before the others, ids and sizes descending: what comes last of an id is the next document of the id after it."""
    plain = zstandard.ZstdDecompressor().decompress
    at, last, following, ready, size = None, "", "", [], 0
    for batch in batches:
        for bucket, copy, doc, key, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = plain(blob).decode()
            if not copy:
                if (bucket, key) != at:
                    at, following = (bucket, key), last
                ready.append((doc, text, following))
                size += len(text)
            last = text
            if size >= BLOCK_BYTES:
                yield _told(ready)
                ready, size = [], 0
    if ready:
        yield _told(ready)


def _told(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    docs, texts, following = zip(*rows, strict=True)
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # runs of rows share their next document, which mostly is the next row
    distinct = list(dict.fromkeys((*texts, *changed, *following)))
    prints = sketches(distinct)
    number = {t: i for i, t in enumerate(distinct)}
    own, other, after = (prints[[number[t] for t in x]] for x in (texts, changed, following))
    columns = (docs, map(len, texts), (hashlib.sha256(t.encode()).hexdigest() for t in changed), hexed(own), hexed(other), likeness(own, other), likeness(own, after))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
