"""SimHash near-duplicate classes through Golay-code keys.

Two 64-bit fingerprints within three bits agree, in one of their 32-bit halves,
to within one bit; of that half's two 16-bit segments one is then equal and the
other differs in at most one bit. A key therefore joins an exact segment with a
codeword of the extended (24, 12, 8) Golay code near the other segment. A 24-bit
word lies within distance three of one codeword or at distance four from six, so
two words one bit apart always have a codeword in common, and a segment gives
one or six keys. Candidates that share a key are verified bit by bit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut, flat, lean, parts, plain_docs, slices, unboxed, written
from .graphs import components
from .near_links import SET_BITS, connected, ones, parities, shingled

#: The ASCII white space of a word boundary, and the generator polynomial of the binary Golay code.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
GOLAY = 0b101011100011
SHINGLE_WORDS, MAX_BITS, LINK_BLOCK, SMALL_KEY = 3, 3, 2048, 8
#: For classes by similarity: words of a shingle, fingerprints, and bits of 64 x COUNT that nearly all texts of which 0.8 of all shingles are shared stay within.
SIMILAR_WORDS, COUNT, SIMILAR_BITS = 5, 3, 44
#: Bytes of a set's size and parities.
BOUND = 8 + SET_BITS // 8
#: Bytes of text whose words are hashed at once.
TEXT_BYTES = 1 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}
_BREAK = {ord(c): " " for c in SPACE}


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, in order; a text of fewer words is one shingle, one without words has none."""
    parts = [w for w in text.translate(_LOWER).translate(_BREAK).split(" ") if w]
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        shingles = [" ".join(parts)]
    else:
        shingles = map(" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in map(str.encode, shingles)), np.uint64)


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte, the one it counts as (letters in lower case), and whether it ends a word."""
    low, white = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    low[65:91] += 32
    white[[ord(c) for c in SPACE]] = True
    return low, white


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(2 * TEXT_BYTES, x, np.uint64)], dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places where words start, their hashes) in at most 2 x TEXT_BYTES bytes; a word also ends where breaks says that a text does."""
    low, white = _byte_tables()
    blank = white[data]
    starts = np.flatnonzero(~blank & (breaks[:-1] | np.r_[True, blank[:-1]]))
    ends = np.flatnonzero(~blank & (breaks[1:] | np.r_[blank[1:], True])) + 1
    up, down = _powers()
    total = np.r_[np.uint64(0), np.cumsum((low[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]
    return starts, _mixed((total[ends] - total[starts]) * down[starts])


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text of a column, the distinct hashes of its shingles: 64-bit hashes of words put together in order; a text of fewer words is one shingle."""
    data, offsets = flat(column)
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets, TEXT_BYTES):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        breaks = np.zeros(len(own) + 1, bool)
        breaks[at] = True
        starts, hashes, begin = [], [], 0
        while begin < len(own):
            # a long text is cut at white space, or in the middle of a word as long as a piece
            end = min(begin + TEXT_BYTES, len(own))
            gap = np.flatnonzero(_byte_tables()[1][own[end : end + TEXT_BYTES]])
            end = len(own) if end == len(own) else end + (int(gap[0]) if len(gap) else min(TEXT_BYTES, len(own) - end))
            x, h = _word_hashes(own[begin:end], breaks[begin : end + 1])
            starts.append(x + begin)
            hashes.append(h)
            begin = end
        start, word = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((starts, np.int64), (hashes, np.uint64)))
        text = np.searchsorted(at, start, side="right") - 1
        count = np.bincount(text, minlength=hi - lo)
        first = np.cumsum(count) - count
        joined = word[: max(0, len(word) - words + 1)]
        for k in range(1, words):
            joined = _mixed(joined * np.uint64(0x94D049BB133111EB) + word[k : k + len(joined)])
        for n, a in zip(count.tolist(), first.tolist(), strict=True):
            if n >= words:
                out.append(np.unique(joined[a : a + n - words + 1]))
            else:
                h = word[a : a + min(n, 1)]
                for k in range(1, n):
                    h = _mixed(h * np.uint64(0x94D049BB133111EB) + word[a + k : a + k + 1])
                out.append(h)
    return out


def fingerprint(text: str, words: int = SHINGLE_WORDS, count: int = 1) -> list[int]:
    """Majorities of the bits of the shingles' XXH64, as an unsigned number; further ones, of the same hashes mixed anew."""
    return _majorities(shingle_hashes(text, words), count)


def _majorities(hashes: np.ndarray, count: int) -> list[int]:
    if not len(hashes):
        return [0] * count
    ones = np.zeros((count, 64), np.int64)
    for lo in range(0, len(hashes), 65536):
        part = hashes[lo : lo + 65536]
        for k in range(count):
            if k:
                part = (part ^ (part >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                part ^= part >> np.uint64(29)
            ones[k] += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel().tolist()


@lru_cache(1)
def codeword_keys() -> list[list[int]]:
    """For each 16-bit segment (padded with zeros to 24 bits), the numbers of the nearest Golay codewords."""
    data = np.arange(4096, dtype=np.int64)
    rest = data << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    code = (data << 11 | rest) << 1
    code |= np.bitwise_count(code) & 1
    out = []
    code = code.astype(np.uint32)
    for lo in range(0, 65536, 256):
        distance = np.bitwise_count(np.arange(lo, lo + 256, dtype=np.uint32)[:, None] ^ code[None, :])
        near = distance == distance.min(axis=1, keepdims=True)
        out += [np.flatnonzero(row).tolist() for row in near]
    return out


@lru_cache(1)
def _key_table() -> tuple[np.ndarray, np.ndarray]:
    """codeword_keys as an array padded to six, and how many each segment has."""
    keys = codeword_keys()
    size = np.array(list(map(len, keys)))
    out = np.zeros((65536, 6), np.int64)
    out[np.arange(6) < size[:, None]] = np.concatenate(keys)
    return out, size


def exact_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that rows within three bits share a key: an exact segment and a codeword near its neighbour."""
    table, size = _key_table()
    rows, keys = [], []
    for side in range(4):
        near, exact = (prints[:, 0] >> np.uint64(16 * x) & np.uint64(0xFFFF) for x in (side, side ^ 1))
        near = near.astype(np.int64)
        row, which = np.nonzero(np.arange(6) < size[near][:, None])
        rows.append(row)
        keys.append(((side << 12) + table[near[row], which] << 16) + exact.astype(np.int64)[row])
    return np.concatenate(rows), np.concatenate(keys)


def similar_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the codewords near each two segments of each fingerprint: rows that differ in a sixth of their bits share one in nineteen cases of twenty."""
    table, size = _key_table()
    rows, keys = [], []
    for k in range(prints.shape[1]):
        segments = [(prints[:, k] >> np.uint64(16 * x) & np.uint64(0xFFFF)).astype(np.int64) for x in range(4)]
        for a in range(4):
            for b in range(a):
                x, y = segments[a], segments[b]
                row, i, j = np.nonzero((np.arange(6) < size[x][:, None])[:, :, None] & (np.arange(6) < size[y][:, None])[:, None, :])
                rows.append(row)
                keys.append((((k * 4 + a) * 4 + b << 12) + table[x[row], i] << 12) + table[y[row], j])
    return np.concatenate(rows), np.concatenate(keys)


def _least_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least codeword near both of two rows of segments; a large number if there is none."""
    table, size = _key_table()
    a, b = (np.where(np.arange(6) < size[v][:, None], table[v], none) for v, none in ((x, -1), (y, -2)))
    return np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, 1 << 40).min(axis=1)


def _segments(prints: np.ndarray, k: int) -> list[np.ndarray]:
    return [(prints[:, k] >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]


def least_exact_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of the keys that rows of x and y share by exact_keys."""
    own, other = _segments(x, 0), _segments(y, 0)
    out = np.full(len(x), np.iinfo(np.int64).max)
    for side in range(4):
        code = _least_shared(own[side], other[side])
        both = (own[side ^ 1] == other[side ^ 1]) & (code < 4096)
        out = np.minimum(out, np.where(both, ((side << 12) + code << 16) + own[side ^ 1], out))
    return out


def least_similar_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of the keys that rows of x and y share by similar_keys."""
    out = np.full(len(x), np.iinfo(np.int64).max)
    for k in range(x.shape[1]):
        code = [_least_shared(a, b) for a, b in zip(_segments(x, k), _segments(y, k), strict=True)]
        for a in range(4):
            for b in range(a):
                both = (code[a] < 4096) & (code[b] < 4096)
                out = np.minimum(out, np.where(both, (((k * 4 + a) * 4 + b << 12) + code[a] << 12) + code[b], out))
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, count: int = 1) -> DataFrame:
    """(doc_id, hash, node, f0, f1, ...): one row per input row, with the text's xxhash64; fingerprints are the bits of longs, node stands for all of a row's."""
    names = [f"f{k}" for k in range(count)]

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, words, count) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, count)
            columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (_node(prints), *prints.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "hash", "node", *names])

    return plain_docs(docs, id_col=id_col, text_col=text_col).withColumn("hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, hash long, node long, " + ", ".join(f"{n} long" for n in names))


def _node(prints: np.ndarray) -> np.ndarray:
    """One number for a row of fingerprints: a single one itself."""
    out = prints[:, 0].copy()
    for k in range(1, prints.shape[1]):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) ^ prints[:, k]
    return out


def links(prints: DataFrame, *, similar: bool = False) -> DataFrame:
    """Links (a, b) between the nodes of prints(node, f0, ...) whose fingerprints differ in at most MAX_BITS bits, or SIMILAR_BITS if similar.

    The links connect every class that the rows sharing keys connect. A key with
    few rows gives its pairs at once, one with up to LINK_BLOCK a spanning forest
    of its links. The rows of a larger key stream through a task into blocks of
    that size, and each two blocks of a key are compared by themselves and give
    a forest. Of the keys that two rows share only the least gives their link:
    there they are compared as well, so what links them stays.
    """
    names = [c for c in prints.columns if c[0] == "f" and c[1:].isdigit()]
    own = prints.select("node", *names).distinct()
    limit, keys_of, least = (SIMILAR_BITS, similar_keys, least_similar_key) if similar else (MAX_BITS, exact_keys, least_exact_key)

    def keyed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                columns = [np.asarray(c).astype(np.int64) for c in batch.slice(lo, 1024).columns[1:]]
                row, key = keys_of(np.stack(columns, axis=1).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[row]) for c in columns)], ["key", *names])

    def block(key: int, number: int, rows: np.ndarray) -> pa.RecordBatch:
        return _told(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [key], [number], [rows.tobytes()])

    def whole(key: np.ndarray, rows: np.ndarray, gone: int):
        """What comes of all rows of some keys, in order of key; gone blocks of the first key went before."""
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        large = size > LINK_BLOCK
        large[0] |= gone > 0
        for lo, n in zip(start[large].tolist(), size[large].tolist(), strict=True):
            first = gone if lo == 0 else 0
            for no, at in enumerate(range(lo, lo + n, LINK_BLOCK)):
                yield block(int(key[lo]), first + no, rows[at : min(at + LINK_BLOCK, lo + n)])
        here = ~np.repeat(large, size)
        x, y = _batch(key[here], rows[here], limit, least)
        yield _told(x, y, pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary()))

    def linked(batches):
        key, rows, gone = np.zeros(0, np.int64), np.zeros((0, len(names)), np.uint64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.r_[key, np.asarray(batch.column(0))]
            rows = np.concatenate([rows, np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1).view(np.uint64)])
            if last := int(np.searchsorted(key, key[-1])):
                yield from whole(key[:last], rows[:last], gone)
                key, rows, gone = key[last:], rows[last:], 0
            while len(key) >= 2 * LINK_BLOCK:
                yield block(int(key[0]), gone, rows[:LINK_BLOCK])
                key, rows, gone = key[LINK_BLOCK:], rows[LINK_BLOCK:], gone + 1
        if len(key):
            yield from whole(key, rows, gone)

    def compared(batches):
        held = None
        for batch in batches:
            for key, lo, hi, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "rows")), strict=True):
                found = np.frombuffer(raw, np.uint64).reshape(-1, len(names))
                if lo == hi:
                    a = b = np.arange(len(found))
                elif held is None:
                    held = found
                    continue
                else:
                    a, b = np.arange(len(held)), np.arange(len(held), len(held) + len(found))
                    found, held = np.concatenate([held, found]), None
                x, y = _forest(found, a, b, limit)
                mine = least(found[x], found[y]) == key
                node = _node(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[x[mine]]), pa.array(node[y[mine]])], ["a", "b"])

    longs = ", ".join(f"{n} long" for n in names)
    met = own.mapInArrow(lean(keyed), f"key long, {longs}").repartition("key").sortWithinPartitions("key", *names)
    found = cut(met.mapInArrow(lean(linked), "a long, b long, key long, block int, rows binary"))
    blocks = found.where("rows is not null").select("key", "block", "rows")
    counted = blocks.groupBy("key").agg((F.max("block") + 1).alias("n_blocks"))
    each = blocks.join(counted, "key").repartition("key", "block").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    paired = each.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rows")
    far = paired.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block").mapInArrow(lean(compared), "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(far).distinct()


def _told(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "key", "block", "rows"])


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def _batch(key: np.ndarray, found: np.ndarray, limit: int, least) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of each of some whole keys, in order of key."""
    node = _node(found).view(np.int64)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    size = np.diff(np.r_[start, len(key)])
    small = np.repeat(size <= SMALL_KEY, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, SMALL_KEY):
        at = np.flatnonzero(small[:-step] & (key[step:] == key[:-step]))
        at = at[_apart(found[at], found[at + step]) <= limit]
        left.append(at)
        right.append(at + step)
    for lo, n in zip(start[size > SMALL_KEY], size[size > SMALL_KEY], strict=True):
        x, y = _forest(found, own := np.arange(lo, lo + n), own, limit)
        left.append(x)
        right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    here = key[x] == least(found[x], found[y])
    return node[x[here]], node[y[here]]


def _close(left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of left and right lie within limit bits, as a matrix made in strips of a few MB."""
    out = np.empty((len(left), len(right)), bool)
    for lo in range(0, len(left), 128):
        apart = sum(np.bitwise_count(left[lo : lo + 128, k][:, None] ^ right[:, k][None, :]).astype(np.int16) for k in range(left.shape[1]))
        out[lo : lo + 128] = apart <= limit
    return out


def _forest(found: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of rows (or within one), by a walk over their matrix that meets each row once."""
    near = _close(found[a], found[b], limit)
    from_side = (near, near if a is b else np.ascontiguousarray(near.T))
    unmet = (np.ones(len(a), bool), np.ones(len(b), bool))
    if a is b:
        unmet = (unmet[0], unmet[0])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not unmet[0][start]:
            continue
        unmet[0][start] = False
        stack = [(0, start)]
        while stack:
            side, x = stack.pop()
            new = np.flatnonzero(from_side[side][x] & unmet[1 - side])
            if len(new):
                unmet[1 - side][new] = False
                own = (a, b)[side][x]
                left.append(np.full(len(new), own))
                right.append((b, a)[side][new])
                stack += [(1 - side, y) for y in new.tolist()]
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id reachable through fingerprints that
    differ in at most three bits. A null or empty text, or one of white space,
    has fingerprint zero and is linked like any other. Repeated rows each come
    back; a null doc_id never becomes a component's number unless the component
    has no other. Copies share a fingerprint, so only distinct fingerprints are
    keyed and linked.
    """
    found = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    root = components(links(found)).select("node", "root")
    ids = found.groupBy("node").agg(F.min("doc_id").alias("least")).join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return found.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _with_sets(docs: DataFrame, id_col: str, text_col: str, words: int, count: int) -> DataFrame:
    """(doc_id, hash, set, data, node, f0, ...): fingerprints of the distinct shingles of docs, with set: a hash of all of them, and data: their number, parities and fingerprints."""
    names = [f"f{k}" for k in range(count)]

    def run(batches):
        for batch in parts(batches, 2000):
            found = shingle_sets(batch.column(1), words)
            prints = np.array([_majorities(h, count) for h in found], np.uint64).reshape(-1, count)
            sets = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], np.uint64)
            size = np.array(list(map(len, found)), np.int64)
            data = np.concatenate([size[:, None].view(np.uint8), np.array([parities(h) for h in found], np.uint8).reshape(-1, SET_BITS // 8), prints.view(np.uint8)], axis=1)
            columns = [pa.array([r.tobytes() for r in data], pa.binary()), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (_node(prints), *prints.T))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets.view(np.int64)), *columns], ["doc_id", "hash", "set", "data", "node", *names])

    return plain_docs(docs, id_col=id_col, text_col=text_col).withColumn("hash", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, hash long, set long, data binary, node long, " + ", ".join(f"{n} long" for n in names))


def _likely(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of sizes, parities and fingerprints lie within SIMILAR_BITS and may be of sets of a similarity of 0.8."""
    good = np.flatnonzero(ones(x, y, BOUND, x.shape[1]) <= SIMILAR_BITS)
    a, b = (np.ascontiguousarray(v[good, :8]).view(np.int64).ravel() for v in (x, y))
    # such sets differ in a ninth of their members together at most, and in no fewer than their parities do
    kept = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * ones(x[good], y[good], 8, BOUND) <= a + b)
    out = np.zeros(len(x), bool)
    out[good[kept]] = True
    return out


def similar_classes(docs: DataFrame, found: DataFrame, *, words: int = SIMILAR_WORDS) -> DataFrame:
    """(node, root) of the shingle sets of found(doc_id, hash, set, data, node, f0, ...) that links of a similarity of 0.8 or more connect.

    Of the links by fingerprint, which connect each class of candidates, each is
    checked on the full sets; then pairs of a class within SIMILAR_BITS whose sizes
    and parities allow it, as long as they are not connected. docs(doc_id, hash, text) are the texts.
    """
    names = [c for c in found.columns if c[0] == "f" and c[1:].isdigit()]
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "node", "data", *names)).alias("x")
    own = cut(found.groupBy("set").agg(one).select("set", "x.doc_id", "x.hash", "x.node", "x.data", *(f"x.{n}" for n in names)))
    near = cut(links(own, similar=True))
    root = components(near).select("node", "root")
    classed = own.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = classed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    members = cut(classed.join(counted, "root"))
    sets = written(shingled(docs, members.select(F.col("set").alias("node"), "doc_id", "hash"), lambda texts: shingle_sets(texts, words)))

    # sets of equal fingerprints by the least of them, and that for other fingerprints
    lead = members.groupBy("node").agg(F.min("set").alias("lead"))
    same = members.join(lead, "node").where("set <> lead").select(F.col("set").alias("a"), F.col("lead").alias("b"))
    ends = [lead.select(F.col("node").alias(c), F.col("lead").alias(f"lead_{c}")) for c in ("a", "b")]
    far = near.join(ends[0], "a").join(ends[1], "b").select(F.greatest("lead_a", "lead_b").alias("a"), F.least("lead_a", "lead_b").alias("b"))
    of = members.select(F.col("set").alias("node"), F.col("root").alias("key"), "data")
    return connected(of.select("key", "node"), same.unionByName(far.where("a <> b")), of.select("node", "data"), sets, _likely, BOUND + 8 * len(names))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, count: int = COUNT) -> DataFrame:
    """The rows of docs that stand for their class of near duplicates, other columns as they are.

    Texts are near duplicates if their sets of shingles of words words have a
    Jaccard similarity of 0.8 or more, which is verified for each two texts whose
    fingerprints make them candidates. Of each class the row with the smallest id
    (null last), then text hash, stays; of rows that share both, the one whose
    other columns (maps aside) have the smallest hash. Texts without a word, null
    and empty ones included, are one class: one of their rows stays.
    """
    found = cut(_with_sets(docs, id_col, text_col, words, count))
    texts = plain_docs(docs, id_col=id_col, text_col=text_col).withColumn("hash", F.xxhash64("text"))
    root = similar_classes(texts, found, words=words).select(F.col("node").alias("set"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    best = found.groupBy("set").agg(F.min(order).alias("best")).join(root, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("best").alias("best"))
    chosen = best.select("best.doc_id", F.col("best.hash").alias("chosen"))
    rank = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
    own = boxed(docs, id=F.col(id_col).cast("long"), hash=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), rank=rank)
    kept = own.join(chosen, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("chosen")), "left_semi")
    return unboxed(kept.groupBy("id", "hash").agg(F.min_by("box", "rank").alias("box")), docs)
