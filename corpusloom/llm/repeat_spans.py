"""Repeated byte strings, from the common-prefix interval trees of sparse suffix arrays.

Every string of ``length`` bytes has one minimizer: the leftmost of its k-grams
with the least hash. Equal strings have equal minimizers at equal places, so all
repeats show up among suffixes that start at minimizers whose hash occurs twice,
and those of one hash are put together. Each such group's suffixes are sorted
and a stack scan over their common prefixes yields the interval tree. Suffixes
of an interval share a string to the right of their minimizers, down to the
interval's depth, and are told apart to the left by how far the texts before
them agree: where these extensions differ the repeat is maximal, and every
occurrence is put out, not only neighbours in the array.

Groups of more than ``group_rows`` suffixes aren't gathered: their strings of
``length`` bytes are hashed and counted one by one, which finds the same bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat, joined_by_weight, lean, parts, plain_docs, slices

LENGTH, GRAM, GROUP_ROWS, CHUNK_ROWS, BLOCK_BYTES, STRINGS_AT_ONCE = 400, 128, 65_536, 16_384, 1 << 18, 1_000_000
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_PLACE_BITS = 24


class _Rolling:
    """Hashes of all k-grams of a block by prefix sums of powers modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, k: int) -> np.ndarray:
        n = len(data)
        if n < k:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (self.base, self.back))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        x = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x) - w + 1
    full = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def minimizers(data: np.ndarray, offsets: np.ndarray, rolling: _Rolling, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, hash) for each minimizer of texts laid end to end: it is the minimizer of the strings that start from first to last."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    found, step = [], (1 << _PLACE_BITS) - length
    for lo in range(0, len(data) - length + 1, step):
        block = data[lo : lo + step + length - 1]
        hashes = rolling(block, gram)
        ranked = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_least(ranked, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        found.append((place + lo, hashes[place]))
    place, code = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    start = np.flatnonzero(np.arange(len(place)) + length <= offsets[1:][text])
    place, text, code = place[start], text[start], code[start]
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])][: len(place)]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(place)] - 1
    base = offsets[text[at]]
    return text[at], place[at] - base, start[at] - base, start[end] - base, code[at]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return plain_docs(docs, id_col=id_col, text_col=text_col).select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


_KEY = ["key", "h1", "h2"]


def _packed(rows: DataFrame) -> DataFrame:
    """rows with their texts compressed, for joins that move them: (doc_id, key, h1, h2, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([press(t.encode()) for t in batch.column(4).to_pylist()], pa.binary())], ["doc_id", *_KEY, "blob"])

    return rows.mapInArrow(lean(run), "doc_id long, key long, h1 long, h2 long, blob binary")


def _found(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling(_BASES[0])
        for batch in parts(batches):
            data, offsets = flat(batch.column(3))
            for lo, hi in slices(offsets, BLOCK_BYTES):
                text, place, first, last, code = minimizers(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], rolling, length, gram)
                bounds = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, t)) for x, t in ((place, pa.int32()), (first, pa.int32()), (last, pa.int32()), (code.view(np.int64), pa.int64()))]
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[:3]] + lists, [*_KEY, "place", "first", "last", "code"])

    return rows.select(*_KEY, "text").mapInArrow(lean(run), "key long, h1 long, h2 long, place array<int>, first array<int>, last array<int>, code array<long>")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(texts, occurrences). texts: (key, h1, h2, copies) of one row for each distinct text; occurrences: (key, h1, h2, start, stop, repeat) of repeated strings of at least length bytes in these rows.

    Occurrences of one repeat share its hash. Strings are cut at the reach of the
    minimizer they were found by, so a longer repeat comes back as overlapping
    parts whose union is the repeat. Rows of equal texts count as one here: each
    of their bytes is repeated anyhow.
    """
    rows = _keyed(docs, id_col, text_col)
    texts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("key")).select(*_KEY, "copies")
    stored = cut(_found(rows, length, gram).join(texts, _KEY, "left_semi").dropDuplicates(_KEY))
    each = stored.select(*_KEY, F.explode(F.arrays_zip("place", "first", "last", "code")).alias("x")).select(*_KEY, "x.*")
    shared = cut(each.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hits = joined_by_weight(each, shared, ["code"]).withColumn("many", F.col("n") > group_rows).groupBy(*_KEY).agg(F.collect_list(F.struct("place", "first", "last", "code", "many")).alias("hits"))
    placed = _packed(rows).drop("doc_id").join(hits, _KEY)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_KEY, "code", "place", "left", "right"]
        kinds = (*[pa.int64()] * 4, pa.int32(), pa.binary(), pa.binary())
        plain = zstandard.ZstdDecompressor().decompress
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for batch in parts(batches, 200):
            out, size = [], 0
            for key, h1, h2, blob, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                safe = plain(blob).replace(b"\0", b"\xff")  # no byte of UTF-8, and zero is for padding
                for h in found:
                    first, place, last = h["first"], h["place"], h["last"]
                    out.append((key, h1, h2, h["code"], place, safe[first:place][::-1], safe[place : last + length]))
                    size += last + length - first
                if size > 4 << 20:
                    yield told(out)
                    out, size = [], 0
            if out:
                yield told(out)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [_Rolling(b) for b in _BASES]
        plain = zstandard.ZstdDecompressor().decompress
        texts, held, waiting = [], [], 0
        for batch in parts(batches, 200):
            for *text, blob, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.concatenate([np.arange(h["first"], h["last"] + 1, dtype=np.int32) for h in found])
                raw = np.frombuffer(plain(blob), np.uint8)
                held.append((np.full(len(at), len(texts), np.int32), *(r(raw, length).view(np.int64)[at] for r in rolls), at))
                texts.append(text)
                waiting += len(at)
                if waiting > STRINGS_AT_ONCE:
                    yield _counted(texts, held, length)
                    texts, held, waiting = [], [], 0
        if held:
            yield _counted(texts, held, length)

    # suffixes of groups that can be gathered, and of the others, if there are any
    rare, common = (placed.withColumn("hits", F.filter("hits", test)).where(F.size("hits") > 0) for test in (lambda h: ~h["many"], lambda h: h["many"]))
    few = rare.mapInArrow(lean(contexts), "key long, h1 long, h2 long, code long, place int, left binary, right binary").repartition("code").sortWithinPartitions("code", *_KEY, "place")
    spans = few.mapInArrow(lean(_intervals(length)), "key long, h1 long, h2 long, start int, stop int, repeat long")
    if (shared.agg(F.max("n")).first()[0] or 0) <= group_rows:
        return texts, spans
    # what a batch has counted depends on its rows, so it is stored before it is read again
    counted = cut(common.mapInArrow(lean(strings), "key long, h1 long, h2 long, w1 long, w2 long, start int, stop int"))
    certain = counted.where("stop is not null").select(*_KEY, "start", "stop", F.col("w1").alias("repeat"))
    each = counted.where("stop is null")
    twice = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    single = each.where("start is not null").join(twice, ["w1", "w2"]).select(*_KEY, "start", (F.col("start") + length).cast("int").alias("stop"), F.col("w1").alias("repeat"))
    return texts, spans.unionByName(certain).unionByName(single)


def _counted(texts: list[list[int]], strings: list[tuple[np.ndarray, ...]], length: int) -> pa.RecordBatch:
    """Rows (key, h1, h2, w1, w2, start, stop) for strings (text, w1, w2, start) that are counted together; texts: (key, h1, h2). Empties strings.

    A string met once is put out with its place, to be counted with the other
    batches'. One met again is certain to repeat: its places come out as spans,
    run by run, and its hash once without a place, for the others.
    """
    columns = list(zip(*strings, strict=True))
    strings.clear()
    text, w1, w2, start = (np.concatenate(columns.pop(0)) for _ in range(4))
    order = np.lexsort((start, w2, w1))
    new = np.ones(len(order), bool)
    new[1:] = False
    for w in (w1, w2):
        w = w[order]
        new[1:] |= w[1:] != w[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(order)])
    once, told = order[at[count == 1]], order[at[count > 1]]
    again = order[np.repeat(count > 1, count)]
    del order, new, at, count
    again = again[np.lexsort((start[again], text[again]))]
    t, s = text[again], start[again]
    head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)][: len(s)])
    tail = np.r_[head[1:], len(s)][: len(head)] - 1
    none = lambda n, kind: pa.nulls(n, kind)
    long, int_ = pa.int64(), pa.int32()
    of_keys = [pa.concat_arrays([pa.array(c[text[once]], long), none(len(told), long), pa.array(c[t[head]], long)]) for c in np.array(texts, np.int64).T]
    first = pa.concat_arrays([pa.array(w1[once], long), pa.array(w1[told], long), pa.array(w1[again][head], long)])
    second = pa.concat_arrays([pa.array(w2[once], long), pa.array(w2[told], long), none(len(head), long)])
    starts = pa.concat_arrays([pa.array(start[once], int_), none(len(told), int_), pa.array(s[head], int_)])
    stops = pa.concat_arrays([none(len(once) + len(told), int_), pa.array(s[tail] + length, int_)])
    return pa.RecordBatch.from_arrays([*of_keys, first, second, starts, stops], [*_KEY, "w1", "w2", "start", "stop"])


def _intervals(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.asarray(batch.column("code"))
            # what stands before the last code of the batch is whole
            whole = int(np.argmax(code == code[-1]))
            if whole or (held and held[-1].column("code")[-1].as_py() != code[0]):
                head = [*held, batch.slice(0, whole)] if whole else held
                if sum(b.num_rows for b in head) >= CHUNK_ROWS:
                    yield from _occurrences(pa.Table.from_batches(head), length)
                    held = [batch.slice(whole)]
                    continue
            held.append(batch)
        if held:
            yield from _occurrences(pa.Table.from_batches(held), length)

    return run


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(width, 1)), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = data
    return out, sizes


def _common(matrix: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes rows a and b of a matrix begin with in common."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 8192):
        x, y = a[lo : lo + 8192], b[lo : lo + 8192]
        apart = matrix[x] != matrix[y]
        out[lo : lo + 8192] = np.where(apart.any(axis=1), apart.argmax(axis=1), matrix.shape[1])
    return np.minimum(out, np.minimum(sizes[a], sizes[b]))


def scan(common: list[int]) -> list[tuple[int, int, int]]:
    """The interval tree of a sorted suffix array: (first, last, depth), where common[i] is the common prefix of suffixes i and i + 1, negative between groups."""
    out, stack = [], []
    for i, depth in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, reach = stack.pop()
            out.append((first, i, reach))
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))
    return out


def _occurrences(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    code = np.asarray(table.column("code").combine_chunks())
    right, right_size = _matrix(table.column("right"), length)
    left, left_size = _matrix(table.column("left"), length)
    order = np.lexsort((np.argsort(np.argsort(right.view(f"S{right.shape[1]}").ravel(), kind="stable"), kind="stable"), code))
    shared = _common(right, order[:-1], order[1:], right_size)
    shared[code[order[:-1]] != code[order[1:]]] = -1
    tree = scan(shared.tolist())
    if not tree:
        return
    rank = np.argsort(np.argsort(left.view(f"S{left.shape[1]}").ravel(), kind="stable"), kind="stable")
    first, last, depth = np.array(tree, np.int64).T
    size = last - first + 1
    keys = [np.asarray(table.column(c).combine_chunks()) for c in _KEY]
    place = np.asarray(table.column("place").combine_chunks())
    rights, lefts = table.column("right"), table.column("left")
    lo = 0
    while lo < len(tree):
        # as many intervals as make up some hundred thousand members
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), 200_000)) + lo)
        count = size[lo:hi]
        node = np.repeat(np.arange(lo, hi), count)
        member = order[np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + first[node]]
        by_left = np.lexsort((rank[member], node))
        member, node = member[by_left], node[by_left]
        agree = _common(left, member[:-1], member[1:], left_size)
        agree[node[:-1] != node[1:]] = -1
        # the furthest that any other member's text agrees to the left: beyond it the extensions differ
        back = np.maximum(np.r_[-1, agree], np.r_[agree, -1])
        reach = np.minimum(depth[node], right_size[member])
        keep = (back >= 0) & (back + reach >= length)
        m, b, r = member[keep], back[keep], reach[keep]
        if len(m):
            name = [xxhash.xxh3_64_intdigest(lefts[i].as_py()[:x][::-1] + rights[i].as_py()[:y]) - (1 << 63) for i, x, y in zip(m.tolist(), b.tolist(), r.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[m]) for k in keys), pa.array(place[m] - b, pa.int32()), pa.array(place[m] + r, pa.int32()), pa.array(name, pa.int64())], [*_KEY, "start", "stop", "repeat"])
        lo = hi


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row per row of docs.

    A byte goes if a string of length bytes that covers it starts anywhere else,
    in the same document or another; strings are judged on the input. A null text
    counts as empty. Rows with equal texts lose everything if length bytes long.
    """
    texts, found = repeats(docs, id_col=id_col, text_col=text_col, length=length, gram=gram, group_rows=group_rows)
    spans = found.select(*_KEY, "start", "stop").distinct().groupBy(*_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    info = texts.join(spans, _KEY, "left")
    rows = _packed(_keyed(docs, id_col, text_col)).join(info, _KEY, "left").select("doc_id", "blob", "copies", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = []
            for doc, blob, copies, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = zstandard.decompress(blob)
                # only the one row that stands for a text met its entry
                gone = ([(0, len(raw))] if len(raw) >= length else []) if copies != 1 else merged([(s["start"], s["stop"]) for s in found or ()])
                kept, at = hashlib.sha256(), 0
                for start, stop in gone:
                    kept.update(raw[at:start])
                    at = stop
                kept.update(raw[at:])
                out.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"start": a, "stop": b} for a, b in gone]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")
