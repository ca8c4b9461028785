"""Best-fit packing of token pieces, improved by swap-based local search."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, cut, flat, lean, plain_docs, slices

LENGTH, END_ID, GROUP_ROWS = 4096, 1, 16_384
#: Words remembered by a task, the longest of them, words of one text for the tokenizer, and bytes of text handled at once.
MOST_WORDS, MOST_CHARS, JOINED_WORDS, TEXT_BYTES = 500_000, 64, 50, 4 << 20
#: Texts that are not made plain: with white space or letters beyond those whose case is changed one by one, or the beginning of a special token; with a point or comma that ends a word but stands after another mark, with which it is one piece.
WIDE, MARKED = r"[\x1c-\x1f\x{130}\x{250}-\x{10ffff}]|<\|", r"[^a-z0-9ß-öø-ÿ\s][.,]\s"
#: Separators at which Arrow splits, but not the tokenizer.
CONTROLS = r"[\x1c-\x1f]"
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def plain(texts: pa.Array) -> pa.Array:
    """texts with fewer distinct words and the same ids: in lower case, as the tokenizer reads them anyhow, and with points and commas apart from the words they end."""
    low = pc.if_else(pc.match_substring_regex(texts, WIDE), texts, pc.utf8_lower(texts))
    out = low
    for mark in (", ", ". ", ",\n", ".\n"):
        out = pc.replace_substring(out, mark, " " + mark)
    return pc.if_else(pc.or_(pc.match_substring_regex(texts, WIDE), pc.match_substring_regex(low, MARKED)), low, out)


class WordIds(Remembered):
    """Ids of texts by the words between white space, from a tokenizer that reads them in lower case, drops white space and never joins letters with other marks; another one is refused."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        super().__init__(most_words)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        normal, parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix or normal is None or parts is None or normal.normalize_str("A \n É") != "a é" or [x for x, _ in parts.pre_tokenize_str("ab12 ., b")] != ["ab", "1", "2", ".,", "b"]:
            raise ValueError(f"not a tokenizer of words in lower case: {path}")
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[x for token, x in vocabulary.items() if token.endswith(suffix)]] = True

    def _coded(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit bytes. Words of letters are single pieces to the tokenizer, so it reads many of them as one text."""
        out: list[bytes] = [b""] * len(words)
        letters, others = [], []
        for i, w in enumerate(words):
            (letters if _LETTERS.fullmatch(w) else others).append(i)
        rows = [letters[i : i + JOINED_WORDS] for i in range(0, len(letters), JOINED_WORDS)]
        coded = self.tokenizer.encode_batch_fast([*(" ".join(words[i] for i in row) for row in rows), *(words[i] for i in others)], add_special_tokens=False)
        for row, found in zip(rows, coded, strict=False):
            ids = np.array(found.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for i, end in zip(row, (4 * np.flatnonzero(self.is_last[ids]) + 4).tolist(), strict=True):
                out[i] = raw[at:end]
                at = end
        for i, found in zip(others, coded[len(rows) :], strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, the n + 1 places at which texts begin)."""
        texts = plain(texts.cast(pa.large_string()))
        # as a word of its own, the tokenizer reads such a text whole
        odd = np.asarray(pc.match_substring_regex(texts, CONTROLS))
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        coded = pc.dictionary_encode(split.flatten())
        code, words, ends = np.asarray(coded.indices), coded.dictionary.to_pylist(), np.asarray(split.offsets).astype(np.int64)
        if odd.any():
            at = np.flatnonzero(odd)
            code = np.insert(code, ends[at + 1], len(words) + np.arange(len(at), dtype=code.dtype))
            words += texts.take(pa.array(at)).to_pylist()
            ends = ends + np.cumsum(np.r_[0, odd])
        found = list(map(self.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            unmet = []
            for i in missing:
                if (x := self.older.get(words[i])) is None:
                    unmet.append(i)
                else:
                    found[i] = x
            for i, x in zip(unmet, self._coded([words[i] for i in unmet]), strict=True):
                found[i] = x
            for i in missing:
                if len(words[i]) <= MOST_CHARS:
                    self.put(words[i], found[i])
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        first = np.cumsum(size, dtype=np.int64) - size
        count = size[code]
        before = np.cumsum(np.r_[0, count], dtype=np.int64)
        place = np.repeat(first[code] - before[:-1], count)
        place += np.arange(before[-1])
        return ids[place], before[ends]


@lru_cache(2)
def word_ids(path: str, most_words: int) -> WordIds:
    return WordIds(path, most_words)


def pieces(docs: DataFrame, path: str, *, length: int = LENGTH, end_id: int = END_ID, most_words: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids and end_id, cut only if they are more than length. An empty or null text is the end_id alone.

    A worker remembers up to twice most_words words, some 200 bytes each, also
    while it runs other operators' tasks.
    """

    def run(batches):
        words, end = word_ids(path, most_words), end_id.to_bytes(4, "little")
        for batch in batches:
            docs, texts, rows = batch.column(0).to_pylist(), batch.column(1), []
            for lo, hi in slices(flat(texts)[1], TEXT_BYTES):
                ids, places = words.encode(texts.slice(lo, hi - lo))
                raw = memoryview(ids.tobytes())
                for doc, a, b in zip(docs[lo:hi], places[:-1].tolist(), places[1:].tolist(), strict=True):
                    for no, at in enumerate(range(a, b + 1, length)):
                        # the end stands after the last id
                        own = crc32(raw[4 * at : 4 * min(at + length, b)])
                        rows.append((doc, no, at - a, min(at + length, b + 1) - at, own if at + length <= b else crc32(end, own)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return plain_docs(docs, id_col=id_col, text_col=text_col).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins, free, open_ = [], [[] for _ in range(room + 1)], 0
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        if fits := open_ >> size:
            left = size + (fits & -fits).bit_length() - 1
            at = free[left].pop()
            if not free[left]:
                open_ &= ~(1 << left)
            bins[at].append(item)
        else:
            left, at = room, len(bins)
            bins.append([item])
        left -= size
        if left:
            free[left].append(at)
            open_ |= 1 << left
    return bins


def least_bins(sizes: list[int], room: int) -> int:
    """As many bins as any packing needs: items over half a bin each need their own, and the rest what these leave."""
    size = np.sort(np.array(sizes, np.int64))
    total = np.r_[0, np.cumsum(size)]
    least = -(-int(total[-1]) // room)
    for low in np.unique(np.r_[0, size[2 * size <= room]]).tolist():
        # items over room - low share a bin with none of low or more
        alone, half = (int(np.searchsorted(size, x, side="right")) for x in (room - low, room // 2))
        middle = int(total[alone] - total[half])
        small = int(total[half] - total[np.searchsorted(size, low)])
        rest = small - ((alone - half) * room - middle)
        least = max(least, len(size) - half + max(0, -(-rest // room)))
    return least


def local_search(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Empties bins by moves and one-for-one and two-for-one exchanges between underfull bins.

    The least full bin gives first. Of all steps that it can take with any other
    underfull bin it takes the one that adds most to the sum of squared fills,
    until none adds to it or the bin is empty. Passes over all underfull bins
    follow each other until the bins are as few as any packing has (least_bins)
    or a pass empties none.
    """
    least, count = least_bins(sizes, room), len(bins)
    if count <= least:
        return bins
    size, bin_of = np.array(sizes, np.int64), np.empty(len(sizes), np.int64)
    for number, items in enumerate(bins):
        bin_of[items] = number
    fill = np.bincount(bin_of, weights=size, minlength=len(bins)).astype(np.int64)
    emptied = True
    while emptied and count > least:
        emptied = False
        for giver in np.argsort(fill, kind="stable").tolist():
            if count <= least:
                break
            # nothing to give, or more than the others can take
            if not fill[giver] or fill[giver] >= room or int((room - fill[fill > 0]).sum()) - (room - fill[giver]) < fill[giver]:
                continue
            while fill[giver] and (step := _exchange(giver, size, bin_of, fill, room)):
                taker, out, back = step
                gain = int(size[out].sum() - size[back].sum())
                bin_of[out], bin_of[back] = taker, giver
                fill[giver] -= gain
                fill[taker] += gain
            if not fill[giver]:
                count, emptied = count - 1, True
    order = np.argsort(bin_of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1)]


def _exchange(giver: int, size: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, room: int) -> tuple[int, list[int], list[int]] | None:
    """The step of one bin that adds most to the sum of squared fills: (taker, items out of the giver, items back); none if no step adds to it."""
    own = np.flatnonzero(bin_of == giver)
    own = own[np.argsort(size[own], kind="stable")]
    # of items of one size two are enough
    own = own[np.r_[True, True, size[own][2:] != size[own][:-2]][: len(own)]]
    pairs = own[np.stack(np.triu_indices(len(own), 1), axis=1)]
    pairs = pairs[np.argsort(size[pairs].sum(axis=1), kind="stable")]
    takers = np.flatnonzero((fill > 0) & (fill < room))
    takers = takers[takers != giver]
    others = np.flatnonzero((bin_of != giver) & (fill[bin_of] < room))
    best, step = 0, None
    for out, back in ((own[:, None], None), (own[:, None], others), (pairs, others)):
        taker, returned = (takers, 0) if back is None else (bin_of[back], size[back])
        if len(out) and len(taker):
            sums = size[out].sum(axis=1)
            at = np.searchsorted(sums, room - fill[taker] + returned, side="right") - 1
            gain = sums[np.maximum(at, 0)] - returned
            worth = np.where((at >= 0) & (gain > 0), gain * (fill[taker] - fill[giver] + gain), 0)
            top = int(worth.argmax())
            if worth[top] > best:
                best, step = int(worth[top]), (int(taker[top]), out[at[top]].tolist(), [] if back is None else [int(back[top])])
    return step


def pack(found: DataFrame, *, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Pieces are dealt by hash to groups of about group_rows, as many as the input
    needs, and each group is packed by itself, so a group may have a sequence more
    than its pieces need together with others'. The local search may stop above the
    least number of sequences where pieces are hard to combine. found must be cheap
    to read again (stored or checkpointed).
    """
    groups = max(1, -(-found.count() // group_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        bins = local_search(best_fit(sizes, length), sizes, length)
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for no, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = no, at
                at += sizes[i]
        return pdf.assign(sequence_id=pdf["part"] * (1 << 32) + sequence, offset=offset).drop(columns="part")

    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("part")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return found.select("*", part).groupBy("part").applyInPandas(run, schema)


def packed(docs: DataFrame, path: str, *, length: int = LENGTH, end_id: int = END_ID, most_words: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most length ids. An empty table gives no rows; rows without a doc_id and repeated rows are packed like any other."""
    return pack(cut(pieces(docs, path, length=length, end_id=end_id, most_words=most_words, id_col=id_col, text_col=text_col)), length=length)
