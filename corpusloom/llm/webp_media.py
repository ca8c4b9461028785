"""Lossless WebP: texts stored as pictures, and a reader for the whole lossless format.

The writer packs a payload three bytes to a pixel, 64 pixels to a row. Up to
STRIP_ROWS rows make a still picture, more become the frames of an animation,
each a strip of the canvas, so that a long payload decodes in parallel. Pictures
of few colours are written through a palette; runs and repeated rows as
back-references; recent colours through the colour cache; the rest by prefix
codes fitted to each picture. The reader knows every part of the format: prefix
codes and groups of them, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. It decodes many pictures in
lockstep, a code of each at a time, and finds the pixels of all codes at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import flat, plain_docs, slices

WIDTH, STRIP_ROWS, BLOCK_BYTES, CACHE_BITS, LONGEST_CODE, SHORTEST_RUN = 64, 32, 4 << 20, 7, 12, 4
ROW_BYTES = 3 * WIDTH
TABLE_BYTES = 48 << 20
#: Fixed values of the format: signature, the order of code length codes, the colour cache's multiplier, the opaque black of the predictors.
SIGNATURE, CACHE_FACTOR, BLACK = 0x2F, 0x1E35A7BD, 0xFF000000
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Code lengths of our own code length code: sixteen symbols of four bits each.
OWN_LENGTHS = {*range(14), 17, 18}


@lru_cache(1)
def near_offsets() -> np.ndarray:
    """The 120 short distance codes: (x, y) by distance from the pixel, then by width, right before left."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return np.array(sorted(cells, key=lambda c: (c[0] ** 2 + c[1] ** 2, abs(c[0]), c[0] < 0)))


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra bits, their value) of a length or distance code from one on."""
    v = np.asarray(value, np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    half = v >> np.maximum(high - 1, 0) & 1
    small = v < 4
    extra = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + half), extra, np.where(small, 0, v & ((1 << np.maximum(extra, 0)) - 1))


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of code lengths (0: unused) to (symbols by code, code of each symbol by value, whether each row is complete)."""
    ranked = np.where(lengths == 0, 99, lengths).astype(np.int64)
    order = np.argsort(ranked, axis=1, kind="stable")
    size = np.take_along_axis(lengths.astype(np.int64), order, axis=1)
    room = np.where(size > 0, 1 << np.maximum(most - size, 0), 0)
    start = np.cumsum(room, axis=1) - room
    code = np.empty_like(start)
    np.put_along_axis(code, order, np.where(size > 0, start >> np.maximum(most - size, 0), 0), axis=1)
    return order, code, room.sum(axis=1) == 1 << most


@lru_cache(16)
def _reversed(bits: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def fitted_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete code lengths of at most LONGEST_CODE for rows of counts that sum to at most 2**LONGEST_CODE; two symbols at least get one."""
    counts = counts.astype(np.int64)
    lone = (counts > 0).sum(axis=1) < 2
    for i in (0, 1):
        counts[lone, i] = np.maximum(counts[lone, i], 1)
    # a lone symbol beyond the first two leaves three symbols: still a code
    total = counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        size = np.where(counts > 0, np.maximum(np.ceil(np.log2(total / np.maximum(counts, 1)) - 1e-9), 1), 0).astype(np.int64)
    size = np.minimum(size, LONGEST_CODE)
    order = np.argsort(-counts, axis=1, kind="stable")
    used = int((counts > 0).sum(axis=1).max())
    ranked = np.take_along_axis(size, order, axis=1)[:, :used]
    left = (1 << LONGEST_CODE) - np.where(ranked > 0, 1 << (LONGEST_CODE - ranked), 0).sum(axis=1)
    if (left < 0).any():
        raise ValueError("too many symbols for the longest code")
    while (left > 0).any():
        for i in range(used):
            gain = np.where(ranked[:, i] > 1, 1 << (LONGEST_CODE - ranked[:, i]), 0)
            take = (gain > 0) & (gain <= left)
            ranked[take, i] -= 1
            left -= np.where(take, gain, 0)
    out = np.zeros_like(size)
    np.put_along_axis(out, order[:, :used], ranked, axis=1)
    return out


# ---------------------------------------------------------------- writer


class _Bits:
    """Collects (row, value, bits) tokens of many pictures; within a row they stay in the order they were added."""

    def __init__(self):
        self.row, self.value, self.size = [], [], []

    def add(self, row: np.ndarray, value, size) -> None:
        self.row.append(row)
        self.value.append(np.broadcast_to(np.asarray(value, np.uint64), row.shape))
        self.size.append(np.broadcast_to(np.asarray(size, np.int64), row.shape))

    def packed(self, rows: int) -> list[bytes]:
        row, value, size = (np.concatenate(x) for x in (self.row, self.value, self.size))
        order = np.argsort(row, kind="stable")
        row, value, size = row[order], value[order], size[order]
        per_row = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        start = np.cumsum((per_row + 7) // 8) - (per_row + 7) // 8
        first = np.cumsum(np.bincount(row, minlength=rows)) - np.bincount(row, minlength=rows)
        run = np.cumsum(size) - size
        at = start[row] * 8 + run - np.r_[run, 0][first[row]]
        out = np.zeros(int(((per_row + 7) // 8).sum()) + 8, np.uint8)
        shifted, byte = value << (at & 7).astype(np.uint64), at >> 3
        for k in range(8):
            part = (shifted >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint8)
            some = np.flatnonzero(part)
            if not len(some) and k > 6:
                break
            np.add.at(out, byte[some] + k, part[some])
        data = out.tobytes()
        return [data[a : a + b] for a, b in zip(start.tolist(), ((per_row + 7) // 8).tolist(), strict=True)]


def _write_lengths(bits: _Bits, rows: np.ndarray, lengths: np.ndarray) -> None:
    """One prefix code per picture, its lengths run-length coded."""
    fixed = [(0, 1), (13, 4), *((4 if s in OWN_LENGTHS else 0, 3) for s in CODE_ORDER[:17]), (0, 1)]
    for value, size in fixed:
        bits.add(rows, value, size)
    symbols = sorted(OWN_LENGTHS)
    code_of = np.zeros(19, np.int64)
    code_of[symbols] = _reversed(4)[np.arange(16)]
    n, width = lengths.shape
    cell = lengths.ravel()
    fresh = np.r_[True, (cell[1:] != cell[:-1]) | (cell[1:] != 0)]
    fresh[np.arange(n) * width] = True
    at = np.flatnonzero(fresh)
    run = np.diff(np.r_[at, len(cell)])
    value, owner = cell[at], rows[at // width]
    zero = value == 0
    # 18 takes up to 138 zeros, 17 up to 10; what is left stands for itself
    whole, rest = np.where(zero, run // 138, 0), np.where(zero, run % 138, 0)
    once = np.where(zero, (rest >= 3).astype(int) + np.where(rest < 3, rest, 0), 1)
    count = whole + once
    index = np.repeat(np.arange(len(at)), count)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    full = nth < whole[index]
    r = rest[index]
    symbol = np.where(full, 18, np.where(~zero[index], value[index], np.where(r >= 11, 18, np.where(r >= 3, 17, 0))))
    extra = np.where(full, 127, np.where(symbol == 18, r - 11, np.where(symbol == 17, r - 3, 0)))
    more = np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))
    bits.add(owner[index], code_of[symbol] | extra << 4, 4 + more)


def _runs(same: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true cells of one row that are SHORTEST_RUN long or more."""
    edge = same & ~np.r_[False, same[:-1] & (row[1:] == row[:-1])]
    start = np.flatnonzero(edge)
    ends = np.flatnonzero(same & ~np.r_[same[1:] & (row[1:] == row[:-1]), False])
    keep = ends - start + 1 >= SHORTEST_RUN
    return start[keep], (ends - start + 1)[keep]


def _coded(bits: _Bits, row: np.ndarray, colour: np.ndarray, across: np.ndarray, cache_bits: int) -> None:
    """Entropy-coded pixels (row: picture of each, across: its row width), with back-references and, if cache_bits, a colour cache."""
    pictures = np.unique(row)
    number = np.searchsorted(pictures, row)
    n = len(colour)
    first = np.searchsorted(row, pictures)
    place = np.arange(n) - first[number]
    step = np.zeros(n, np.int64)  # 0: a pixel of its own, else the length of a reference, -1: inside one
    short = np.zeros(n, np.int64)
    for code, back in ((1, np.ones(n, np.int64)), (0, across)):
        before = np.maximum(np.arange(n) - back, 0)
        same = (place >= back) & (colour == colour[before]) & (step == 0)
        start, length = _runs(same, row)
        inside = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        step[inside] = -1
        step[start], short[start] = length, code
    cached = np.zeros(n, bool)
    if cache_bits:
        slot = (colour.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        # by picture and slot, in order of place
        key = np.sort((number << cache_bits) + slot.astype(np.int64) << 32 | np.arange(n))
        order, cell = key & 0xFFFFFFFF, key >> 32
        was = np.r_[False, (cell[1:] == cell[:-1]) & (colour[order][1:] == colour[order][:-1])]
        cached[order] = was
        cached &= step == 0
    literal = (step == 0) & ~cached
    referred = step > 0
    prefix, extra, more = prefix_of(np.maximum(step, 1))
    green = np.where(literal, colour >> 8 & 255, np.where(referred, LITERALS + prefix, 0))
    if cache_bits:
        green = np.where(cached, LITERALS + LENGTHS + slot.astype(np.int64), green)
    size = LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    told = literal | cached | referred
    codes = []
    for channel, mask, width in ((green, told, size), (colour >> 16 & 255, literal, 256), (colour & 255, literal, 256)):
        counts = np.bincount(number[mask] * width + channel[mask], minlength=len(pictures) * width).reshape(-1, width)
        lengths = fitted_lengths(counts)
        _write_lengths(bits, pictures, lengths)
        code = canonical(lengths, LONGEST_CODE)[1]
        flipped = _reversed(LONGEST_CODE)[code] >> (LONGEST_CODE - lengths)
        codes.append((flipped[number, np.where(mask, channel, 0)], lengths[number, np.where(mask, channel, 0)]))
    bits.add(pictures, 0b1 | 0 << 1 | 1 << 2 | 255 << 3, 11)  # alpha is 255 throughout
    bits.add(pictures, 0b1 | 1 << 1 | 0 << 2 | 0 << 3 | 1 << 4, 12)  # distances are code 0, the row above, or 1, the pixel before
    (g, gs), (r, rs), (b, bs) = codes
    value = np.where(literal, g | r << gs | b << (gs + rs), np.where(referred, g | more << gs | short << (gs + extra), g))
    width = np.where(literal, gs + rs + bs, np.where(referred, gs + extra + 1, gs))
    bits.add(row[told], value[told], width[told])


def write_pictures(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """VP8L data of pictures of WIDTH pixels a row, from payloads of whole rows of RGB bytes laid end to end."""
    n = len(offsets) - 1
    rgb = payload.reshape(-1, 3).astype(np.int64)
    colour = BLACK | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    pixels = np.diff(offsets) // 3
    row = np.repeat(np.arange(n), pixels)
    bits = _Bits()
    every = np.arange(n)
    bits.add(every, SIGNATURE, 8)
    bits.add(every, (WIDTH - 1) | (pixels // WIDTH - 1) << 14, 28)
    bits.add(every, 0, 4)
    shade = row << 24 | colour & 0xFFFFFF
    order = np.argsort(shade)
    shade = shade[order]
    fresh = np.r_[True, shade[1:] != shade[:-1]]
    shades = np.bincount(row[order][fresh], minlength=n)
    few = shades <= 16
    # pictures of few colours: a palette, its colours as differences, and several indices to a pixel
    for_few = np.flatnonzero(few)
    if len(for_few):
        bits.add(for_few, 1 | PALETTE << 1 | (shades[for_few] - 1) << 3, 11)
        listed = order[fresh]
        listed = listed[few[row[listed]]]
        owner, shade = row[listed], colour[listed]
        head = np.r_[True, owner[1:] != owner[:-1]]
        before = np.where(head, 0, np.r_[0, shade[:-1]])
        change = sum(((shade >> s & 255) - (before >> s & 255) & 255) << s for s in (0, 8, 16, 24))
        _table(bits, owner, change)
    bits.add(every, 0, 1)  # no more transforms
    bits.add(np.flatnonzero(~few), 1 | CACHE_BITS << 1, 5)
    bits.add(for_few, 0, 1)
    bits.add(every, 0, 1)  # one group of prefix codes
    rank = np.cumsum(fresh) - 1
    index = np.empty(len(colour), np.int64)
    index[order] = rank - (np.cumsum(shades) - shades)[row[order]]
    own = ~few[row]
    if own.any():
        _coded(bits, row[own], colour[own], np.full(int(own.sum()), WIDTH), CACHE_BITS)
    if len(for_few):
        packs = np.select([shades <= 2, shades <= 4], [3, 2], 1)
        for pack in (1, 2, 3):
            mine = few[row] & (packs[row] == pack)
            if mine.any():
                cells = index[mine].reshape(-1, 1 << pack) << (np.arange(1 << pack) << (3 - pack))
                _coded(bits, row[mine][:: 1 << pack], BLACK | cells.sum(axis=1) << 8, np.full(int(mine.sum()) >> pack, WIDTH >> pack), 0)
    return bits.packed(n)


def _table(bits: _Bits, owner: np.ndarray, change: np.ndarray) -> None:
    """The palettes as pictures one pixel high."""
    pictures = np.unique(owner)
    bits.add(pictures, 0, 1)  # no colour cache
    number = np.searchsorted(pictures, owner)
    codes = []
    for shift in (8, 16, 0, 24):
        channel, width = change >> shift & 255, LITERALS + LENGTHS if shift == 8 else 256
        lengths = fitted_lengths(np.bincount(number * width + channel, minlength=len(pictures) * width).reshape(-1, width))
        _write_lengths(bits, pictures, lengths)
        flipped = _reversed(LONGEST_CODE)[canonical(lengths, LONGEST_CODE)[1]] >> (LONGEST_CODE - lengths)
        codes.append((flipped[number, channel], lengths[number, channel]))
    bits.add(pictures, 0b1 | 0 << 1 | 0 << 2 | 0 << 3, 4)
    value, width = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    for code, size in codes:
        value, width = value | code << width, width + size
    bits.add(owner, value, width)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _contained(strips: list[bytes], rows: list[int]) -> bytes:
    """A WebP file: one picture, or the strips of a canvas as the frames of an animation."""
    if len(strips) == 1:
        body = _chunk(b"VP8L", strips[0])
    else:
        triple = lambda x: struct.pack("<I", x)[:3]
        body = _chunk(b"VP8X", struct.pack("<I", 0x02) + triple(WIDTH - 1) + triple(sum(rows) - 1)) + _chunk(b"ANIM", struct.pack("<IH", BLACK, 1))
        top = 0
        for strip, high in zip(strips, rows, strict=True):
            body += _chunk(b"ANMF", triple(0) + triple(top // 2) + triple(WIDTH - 1) + triple(high - 1) + triple(0) + b"\x02" + _chunk(b"VP8L", strip))
            top += high
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def write_files(texts: list[bytes]) -> list[bytes]:
    """Each text, padded with blanks to whole rows, as a WebP file."""
    padded = [t + b" " * (-len(t) % ROW_BYTES if t else ROW_BYTES) for t in texts]
    cut = STRIP_ROWS * ROW_BYTES
    strips = [p[i : i + cut] for p in padded for i in range(0, len(p), cut)]
    if not strips:
        return []
    data = write_pictures(np.frombuffer(b"".join(strips), np.uint8), np.cumsum([0, *map(len, strips)]))
    out, at = [], 0
    for p in padded:
        n = -(-len(p) // cut)
        out.append(_contained(data[at : at + n], [len(s) // ROW_BYTES for s in strips[at : at + n]]))
        at += n
    return out


# ---------------------------------------------------------------- reader


class _Reader:
    """Bits of one picture's head, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.low, self.window = data, 0, 0, int.from_bytes(data[:256], "little")

    def read(self, n: int) -> int:
        at = self.at - self.low
        if at + n > 2048:
            self.low = self.at & ~7
            self.window = int.from_bytes(self.data[self.low >> 3 : (self.low >> 3) + 256], "little")
            at = self.at - self.low
        self.at += n
        return self.window >> at & (1 << n) - 1

    def peek(self, n: int) -> int:
        at = self.at - self.low
        if at + n > 2048:
            self.read(n)
            self.at -= n
            at = self.at - self.low
        return self.window >> at & (1 << n) - 1


@lru_cache(256)
def _table_of(bits: int, count: int) -> tuple[list[int], int]:
    """Symbol << 4 | length for each pattern of the next bits, and how many bits that is, for a code of count lengths of three bits each."""
    lengths = [0] * 19
    for i, s in enumerate(CODE_ORDER[:count]):
        lengths[s] = bits >> 3 * i & 7
    most = max(lengths)
    order, _, whole = canonical(np.array([lengths]), max(most, 1))
    used = [s for s in order[0].tolist() if lengths[s]]
    if len(used) == 1:
        return [used[0] << 4], 0
    if not whole[0]:
        raise ValueError("an incomplete prefix code")
    listed = np.repeat([s << 4 | lengths[s] for s in used], [1 << (most - lengths[s]) for s in used])
    return listed[_reversed(most)].tolist(), most


def _read_code(r: _Reader, symbols: int) -> np.ndarray:
    """Code lengths; a code of one symbol has length 16 there."""
    out = np.zeros(symbols, np.uint8)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        first = r.read(8 if wide else 1)
        out[first] = 1 if two else 16
        if two:
            out[r.read(8)] = 1
        return out
    count = 4 + r.read(4)
    table, width = _table_of(r.read(3 * count), count)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else symbols
    at, last, mask, peek = 0, 8, (1 << width) - 1, r.peek
    while at < symbols and left:
        left -= 1
        bits = peek(width + 7)  # with those that tell how often
        found = table[bits & mask]
        used, s = found & 15, found >> 4
        bits >>= used
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
        elif s == 16:
            n = 3 + (bits & 3)
            out[at : at + n] = last
            at, used = at + n, used + 2
        elif s == 17:
            at, used = at + 3 + (bits & 7), used + 3
        else:
            at, used = at + 11 + (bits & 127), used + 7
        r.at += used
    used = np.flatnonzero(out)
    if len(used) == 1:
        out[used] = 16
    return out


class _Picture:
    """The head of one VP8L picture, read up to its pixels."""

    def __init__(self, data: bytes):
        self.data = data
        r = _Reader(data)
        if r.read(8) != SIGNATURE:
            raise ValueError("not a lossless picture")
        self.width, self.height = r.read(14) + 1, r.read(14) + 1
        r.read(1)
        if r.read(3):
            raise ValueError("unknown version")
        self.across, self.transforms = self.width, []
        while r.read(1):
            kind = r.read(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = r.read(3) + 2
                wide, high = ((x + (1 << bits) - 1) >> bits for x in (self.across, self.height))
                self.transforms.append((kind, bits, self._small(r, wide, high).reshape(high, wide), self.across))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, 0, None, self.across))
            else:
                size = r.read(8) + 1
                change = self._small(r, size, 1)
                table = sum((np.cumsum(change >> s & 255) & 255) << s for s in (0, 8, 16, 24))
                pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.transforms.append((kind, pack, table, self.across))
                self.across = (self.across + (1 << pack) - 1) >> pack
        self.cache_bits = r.read(4) if r.read(1) else 0
        self.group_bits, self.groups = 0, None
        if r.read(1):
            self.group_bits = r.read(3) + 2
            wide, high = ((x + (1 << self.group_bits) - 1) >> self.group_bits for x in (self.across, self.height))
            self.groups = (self._small(r, wide, high) >> 8 & 0xFFFF).reshape(high, wide)
        count = int(self.groups.max()) + 1 if self.groups is not None else 1
        self.codes = [self._group(r, self.cache_bits) for _ in range(count)]
        self.at = r.at

    @staticmethod
    def _group(r: _Reader, cache_bits: int) -> list[np.ndarray]:
        green = LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
        return [_read_code(r, n) for n in (green, 256, 256, 256, DISTANCES)]

    @classmethod
    def _small(cls, r: _Reader, wide: int, high: int) -> np.ndarray:
        """A picture inside the head: transform data, a palette or the map of code groups."""
        cache_bits = r.read(4) if r.read(1) else 0
        group = cls._group(r, cache_bits)
        out, at = lockstep([_Job(r.data, r.at, wide, high, cache_bits, 0, None, [group])])
        r.at = int(at[0])
        return out[0]


class _Job:
    def __init__(self, data, at, across, height, cache_bits, group_bits, groups, codes):
        self.data, self.at, self.across, self.height, self.cache_bits, self.group_bits, self.groups, self.codes = data, at, across, height, cache_bits, group_bits, groups, codes


def _tables(codes: list[np.ndarray], bits: int) -> np.ndarray:
    """Rows of symbol << 4 | length by the next bits, for codes given by their lengths."""
    width = max(map(len, codes))
    lengths = np.zeros((len(codes), width), np.int64)
    for i, c in enumerate(codes):
        lengths[i, : len(c)] = c
    single = (lengths == 16).any(axis=1)
    out = np.zeros((len(codes), 1 << bits), np.uint16)
    out[single] = (lengths[single] == 16).argmax(axis=1)[:, None] << 4
    rest = np.flatnonzero(~single)
    if len(rest):
        own = lengths[rest]
        order, _, whole = canonical(own, bits)
        if not whole.all():
            raise ValueError("an incomplete prefix code")
        size = np.take_along_axis(own, order, axis=1)
        room = np.where(size > 0, 1 << (bits - size), 0)
        out[rest] = np.repeat((order << 4 | size).ravel(), room.ravel()).reshape(len(rest), 1 << bits)[:, _reversed(bits)]
    return out


def lockstep(jobs: list[_Job]) -> tuple[list[np.ndarray], np.ndarray]:
    """Pixels (as 0xAARRGGBB) of entropy-coded pictures, and the bit after each; one code of every picture at a step, pixels of all at the end."""
    pixels = np.array([j.across * j.height for j in jobs], np.int64)
    group_at = np.cumsum([0, *(len(j.codes) for j in jobs)])[:-1]
    tables, masks = [], []
    for k in range(5):
        codes = [g[k] for j in jobs for g in j.codes]
        masks.append(max(int(np.where(c == 16, 0, c).max()) for c in codes))
        tables.append(_tables(codes, masks[k]).ravel())
    data = b"".join(j.data for j in jobs) + b"\0" * 16
    begin = np.cumsum([0, *(len(j.data) for j in jobs[:-1])])
    # 64 bits from every second byte on, of which 49 stand whatever the bit begun at
    words = np.ndarray(((len(data) - 8) // 2,), "<u8", data, 0, (2,)).copy()
    at = begin * 8 + np.array([j.at for j in jobs], np.int64)
    across = np.array([j.across for j in jobs], np.int64)
    cache_bits = np.array([j.cache_bits for j in jobs], np.int64)
    grouped = any(j.groups is not None for j in jobs)
    if grouped:
        maps = [j.groups if j.groups is not None else np.zeros((1, 1), np.int64) for j in jobs]
        map_at = np.cumsum([0, *(m.size for m in maps[:-1])])
        map_wide = np.array([m.shape[1] for m in maps])
        cells = np.concatenate([m.ravel() for m in maps])
        group_bits = np.array([j.group_bits if j.groups is not None else 20 for j in jobs], np.int64)
    near, together = near_offsets(), sum(masks[:4]) <= 49

    def bits_at(here: np.ndarray) -> np.ndarray:
        return words[here >> 4] >> (here & 15).astype(np.uint64)

    def symbol(k: int, group: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Symbol << 4 | length of code k that bits begin with."""
        return tables[k][(group << masks[k]) + (bits & np.uint64((1 << masks[k]) - 1)).view(np.int64)].astype(np.int64)

    def more_bits(prefix: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of a length or distance prefix, with its extra bits, and the bit after them."""
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        read = bits_at(here).view(np.int64) & ((1 << extra) - 1)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + read + 1), here + extra

    lane, done, end, group = np.arange(len(jobs)), np.zeros(len(jobs), np.int64), at.copy(), group_at
    told: list[tuple[np.ndarray, ...]] = []
    while len(lane):
        if grouped:
            y, x = np.divmod(done, across[lane])
            group = group_at[lane] + cells[map_at[lane] + (y >> group_bits[lane]) * map_wide[lane] + (x >> group_bits[lane])]
        bits = bits_at(at)
        found = symbol(0, group, bits)
        green, used = found >> 4, found & 15
        value, all_used = green << 8, used.copy()
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            bits = bits >> (found & 15).view(np.uint64) if together else bits_at(at + all_used)
            found = symbol(k, group, bits)
            value |= found >> 4 << shift
            all_used += found & 15
        literal = green < LITERALS
        size = np.ones(len(lane), np.int64)
        if not literal.all():
            other = np.flatnonzero(~literal)
            all_used[other] = used[other]
            # the place in the cache, or the distance
            value[other] = green[other] - LITERALS - LENGTHS
            refer = other[green[other] < LITERALS + LENGTHS]
            if len(refer):
                length, here = more_bits(green[refer] - LITERALS, at[refer] + used[refer])
                found = symbol(4, group[refer], bits_at(here))
                code, here = more_bits(found >> 4, here + (found & 15))
                short = np.minimum(code, 120) - 1
                value[refer] = np.where(code > 120, code - 120, np.maximum(near[short, 0] + near[short, 1] * across[lane[refer]], 1))
                if (value[refer] > done[refer]).any():
                    raise ValueError("a reference to before the picture")
                size[refer] = np.minimum(length, pixels[lane[refer]] - done[refer])
                all_used[refer] = here - at[refer]
        told.append((lane.astype(np.int32), green.astype(np.int16), value.astype(np.uint32), size.astype(np.int32)))
        at, done = at + all_used, done + size
        left = done < pixels[lane]
        if not left.all():
            end[lane[~left]] = at[~left]
            lane, at, done, group = lane[left], at[left], done[left], group[left]
    out = _pixels_of(*(np.concatenate(c) for c in zip(*told, strict=True)), pixels, cache_bits)
    return np.split(out, np.cumsum(pixels)[:-1]), end - begin * 8


def _pixels_of(lane: np.ndarray, green: np.ndarray, value: np.ndarray, size: np.ndarray, pixels: np.ndarray, cache_bits: np.ndarray) -> np.ndarray:
    """The pixels of all pictures end to end, from their codes: a colour, a place in the cache or a distance, each for size pixels. Each pixel points to an earlier one of its colour."""
    order = np.argsort(lane.astype(np.uint16) if len(pixels) <= 1 << 16 else lane, kind="stable")
    green, value, size = green[order], value[order].astype(np.int64), size[order]
    total = int(pixels.sum())
    first = np.cumsum(size, dtype=np.int64) - size
    out, source = np.zeros(total, np.int64), np.arange(total)
    literal, hit = green < LITERALS, green >= LITERALS + LENGTHS
    out[first[literal]] = value[literal]
    refer = np.flatnonzero(~literal & ~hit)
    count = size[refer].astype(np.int64)
    copied = np.repeat(first[refer] - np.cumsum(count) + count, count) + np.arange(count.sum())
    source[copied] = copied - np.repeat(value[refer], count)
    _followed(source, copied)
    if hit.any():
        hits = first[hit]
        slot = out.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)
        owner = np.repeat(np.arange(len(pixels)), pixels)
        slot = (slot >> (np.uint64(32) - cache_bits.astype(np.uint64))[owner]).view(np.int64)
        slot[hits] = value[hit]
        slot[copied] = slot[source[copied]]
        cached = np.flatnonzero((cache_bits > 0)[owner])
        # by place in the cache, in order: the last one there that is no hit itself has the colour
        key = np.sort((owner[cached] << int(cache_bits.max())) + slot[cached] << 32 | cached)
        pixel, place = key & 0xFFFFFFFF, key >> 32
        is_hit = np.zeros(total, bool)
        is_hit[hits] = True
        asks = is_hit[pixel]
        last = np.maximum.accumulate(np.where(asks, -1, np.arange(len(key))))
        asking, last = pixel[asks], last[asks]
        known = (last >= 0) & (place[last] == place[asks])
        source[asking[known]] = pixel[last[known]]
        copied = np.concatenate([copied, hits])
        _followed(source, copied)
    out[copied] = out[source[copied]]
    return out


def _followed(source: np.ndarray, some: np.ndarray) -> None:
    """Lets some pixels point to where their chains of earlier pixels begin."""
    while len(some):
        now = source[some]
        then = source[now]
        source[some] = then
        some = some[then != now]


def _split(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1)


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """A predictor's value from the pixels around: left, above, above to the right, above to the left."""
    half = lambda a, b: (a + b) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return half(half(left, right), top)
        case 6:
            return half(left, corner)
        case 7:
            return half(left, top)
        case 8:
            return half(corner, top)
        case 9:
            return half(top, right)
        case 10:
            return half(half(left, corner), half(top, right))
        case 11:
            return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            mean = half(left, top)
            return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int64), 0, 255)
        case _:
            return np.array([255, 0, 0, 0])


def _unpredicted(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    cells, (high, wide) = _split(argb), argb.shape
    kinds = modes >> 8 & 15
    for y in range(high):
        for x in range(wide):
            if not y:
                guess = cells[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                guess = cells[y - 1, 0]
            else:
                right = cells[y - 1, x + 1] if x + 1 < wide else cells[y, 0]
                guess = _predicted(int(kinds[y >> bits, x >> bits]), cells[y, x - 1], cells[y - 1, x], right, cells[y - 1, x - 1])
            cells[y, x] = cells[y, x] + guess & 255
    return cells[..., 0] << 24 | cells[..., 1] << 16 | cells[..., 2] << 8 | cells[..., 3]


def _uncrossed(argb: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    high, wide = argb.shape
    factor = np.repeat(np.repeat(factors, 1 << bits, axis=0), 1 << bits, axis=1)[:high, :wide]
    signed = lambda v: (v & 255 ^ 128) - 128
    share = lambda f, c: signed(f) * signed(c) >> 5
    green = argb >> 8
    red = (argb >> 16) + share(factor, green) & 255
    blue = argb + share(factor >> 8, green) + share(factor >> 16, red) & 255
    return argb & 0xFF00FF00 | red << 16 | blue


def _restored(p: _Picture, coded: np.ndarray) -> np.ndarray:
    """Undoes a picture's transforms, last one first."""
    argb = coded.reshape(p.height, p.across)
    for kind, bits, data, across in reversed(p.transforms):
        if kind == PREDICTOR:
            argb = _unpredicted(argb, data, bits)
        elif kind == CROSS_COLOUR:
            argb = _uncrossed(argb, data, bits)
        elif kind == SUBTRACT_GREEN:
            green = argb >> 8 & 255
            argb = argb & 0xFF00FF00 | ((argb >> 16) + green & 255) << 16 | (argb + green & 255)
        else:
            index = argb >> 8 & 255
            if bits:
                each = 8 >> bits
                index = (index[:, :, None] >> (np.arange(1 << bits) * each) & (1 << each) - 1).reshape(p.height, -1)[:, :across]
            argb = np.where(index < len(data), data[np.minimum(index, len(data) - 1)], 0)
    return argb


def read_pictures(data: list[bytes]) -> list[np.ndarray]:
    """VP8L pictures to arrays of 0xAARRGGBB, rows by columns."""
    pictures = [_Picture(d) for d in data]
    out, lo = [], 0
    while lo < len(pictures):
        # as many at once as their code tables may take
        hi, longest, groups = lo, np.zeros(5, np.int64), 0
        while hi < len(pictures):
            longest = np.maximum(longest, [max(int(np.where(g[k] == 16, 0, g[k]).max()) for g in pictures[hi].codes) for k in range(5)])
            groups += len(pictures[hi].codes)
            if hi > lo and 2 * groups * int((1 << longest).sum()) > TABLE_BYTES:
                break
            hi += 1
        part = pictures[lo:hi]
        found, _ = lockstep([_Job(p.data, p.at, p.across, p.height, p.cache_bits, p.group_bits, p.groups, p.codes) for p in part])
        out += [_restored(p, f) for p, f in zip(part, found, strict=True)]
        lo = hi
    return out


def frames(file: bytes) -> list[tuple[int, int, bytes]]:
    """(x, y, VP8L data) of each picture of a WebP file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out = []
    for name, body in _chunks(file[12 : 8 + struct.unpack_from("<I", file, 4)[0]]):
        if name == b"VP8L":
            out.append((0, 0, body))
        elif name == b"ANMF":
            left, top = (int.from_bytes(body[i : i + 3], "little") * 2 for i in (0, 3))
            out += [(left, top, inner) for kind, inner in _chunks(body[16:]) if kind == b"VP8L"]
    return out


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def read_files(files: list[bytes]) -> list[np.ndarray]:
    """The canvas of each WebP file as an array of 0xAARRGGBB."""
    parts = [frames(f) for f in files]
    pictures = iter(read_pictures([d for p in parts for _, _, d in p]))
    out = []
    for own in parts:
        placed = [(x, y, next(pictures)) for x, y, _ in own]
        if len(placed) == 1:
            out.append(placed[0][2])
            continue
        canvas = np.zeros((max(y + a.shape[0] for _, y, a in placed), max(x + a.shape[1] for x, _, a in placed)), np.int64)
        for x, y, a in placed:
            canvas[y : y + a.shape[0], x : x + a.shape[1]] = a
        out.append(canvas)
    return out


# ---------------------------------------------------------------- columns


_STORED = "doc_id long, n_bytes long, media binary"
_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for lo, hi in slices(offsets, BLOCK_BYTES):
            raw = data[offsets[lo] : offsets[hi]].tobytes()
            own = (offsets[lo : hi + 1] - offsets[lo]).tolist()
            media = write_files([raw[a:b] for a, b in zip(own[:-1], own[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(own), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text as a lossless WebP file. A null or empty text is one row of blanks; equal texts give equal files."""
    return plain_docs(docs, id_col=id_col, text_col=text_col).mapInArrow(_written, _STORED)


def _pixels(media: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(RGB bytes, canvas) of each file, read in blocks."""
    for lo, hi in slices(np.cumsum([0, *map(len, media)]), BLOCK_BYTES // 2):
        for canvas in read_files(media[lo:hi]):
            rgb = np.empty((*canvas.shape, 3), np.uint8)
            for i, s in enumerate((16, 8, 0)):
                rgb[..., i] = canvas >> s & 255
            yield rgb.tobytes(), canvas


def pixel_arrays(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """stored with height, width (ints) and pixels (RGB bytes, row by row) of each file added. A null file has null pixels."""
    names = stored.columns
    at = names.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(at).to_pylist()
            found = iter(_pixels([m for m in media if m is not None]))
            rows = [(None, None, None) if m is None else (lambda x: (*x[1].shape, x[0]))(next(found)) for m in media]
            high, wide, pixels = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(high, pa.int32()), pa.array(wide, pa.int32()), pa.array(pixels, pa.binary())], [*names, "height", "width", "pixels"])

    return stored.mapInArrow(run, StructType([*stored.schema.fields, StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("pixels", BinaryType())]))


def feature(payload: bytes) -> str:
    """Rows, sums of the three channels, and a histogram of brightness in eight steps."""
    rgb = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    light = rgb.astype(np.int64).sum(axis=1) // 96
    return f"{len(rgb) // WIDTH};" + ",".join(map(str, rgb.sum(axis=0, dtype=np.int64).tolist())) + ";" + ",".join(map(str, np.bincount(light, minlength=8).tolist()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2).to_pylist()
        rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)) for m, (p, _) in zip(media, _pixels(media), strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of the payloads decoded from stored(doc_id, n_bytes, media)."""
    return stored.mapInArrow(_digests, _READ)


def stored_and_read(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """read_back(store(docs)) in one Python worker a task: a block of files is read back before the next is written, and none travels."""
    return plain_docs(docs, id_col=id_col, text_col=text_col).mapInArrow(lambda batches: _digests(_written(batches)), _READ)
