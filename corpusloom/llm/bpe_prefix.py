"""Byte-level BPE ids by dynamic programming over prefixes.

For every prefix of a word there is exactly one token its encoding can end in.
An automaton over the vocabulary yields, at each position, all tokens that are
suffixes of the prefix; the one that is compatible with the last token of what
stands before it is stored, and following these back-pointers from the end of
the word emits the ids. Two tokens are compatible if no merge across their
border comes before the merges that form them.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Remembered, plain_docs

MOST_WORDS, MOST_CHARS, MOST_PAIRS = 400_000, 64, 400_000
#: White space as Unicode defines it, and the pre-tokenizer's pattern over it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Runs between white space; they hold whole pieces, as no piece crosses from a word into the white space after it.
RUNS = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class PrefixEncoder(Remembered):
    """Maps a run of text to its ids as little-endian unsigned 32-bit bytes; remembers up to twice MOST_WORDS runs of at most MOST_CHARS characters."""

    def __init__(self, path: str):
        super().__init__(MOST_WORDS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        halves = {self.vocab[a + b]: (self.vocab[a], self.vocab[b], r) for r, (a, b) in enumerate(pairs)}
        self.right, self.left = ({t: self._spine(t, halves, side) for t in self.vocab.values()} for side in (1, 0))
        self.found = ahocorasick.Automaton()
        for token, number in self.vocab.items():
            if token not in self.special:
                self.found.add_word(token, (number, len(token)))
        self.found.make_automaton()
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {n: bytes(back[c] for c in t) for t, n in self.vocab.items() if t not in self.special} | {n: t.encode() for t, n in self.special.items()}
        self.pieces, self.runs = regex.compile(PIECES), re.compile(RUNS)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _spine(token: int, halves: dict, side: int) -> list[tuple[int, float]]:
        """What stands at a token's border while it forms: parts, each with the rank of the merge that ends it."""
        out, ended = [(token, float("inf"))], None
        while ended := halves.get(token):
            token = ended[side]
            out.append((token, ended[2]))
        return out

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            rank = self.rank.get
            # of equal pairs that overlap, the left one merges first
            known = not any((merged := rank((x, y))) is not None and merged < x_ends and merged <= y_ends for x, x_ends in self.right[a] for y, y_ends in self.left[b])
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    def word_ids(self, word: str) -> list[int]:
        """The ids of one piece, written in byte letters."""
        last = [-1] * (len(word) + 1)
        size = last.copy()
        for end, (token, length) in self.found.iter(word):
            if last[end + 1] < 0:
                start = end + 1 - length
                if not start or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[end + 1], size[end + 1] = token, length
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def __missing__(self, run: str) -> bytes:
        out = self.older.get(run)
        if out is None:
            pieces = self.pieces.findall(run)
            if len(pieces) > 1:
                # words that differ in the mark after them share a piece
                out = b"".join(map(self.__getitem__, pieces))
            else:
                ids = self.word_ids(run.encode().decode("latin-1").translate(self.letters))
                out = pack(f"<{len(ids)}I", *ids)
        if len(run) <= MOST_CHARS:
            self.put(run, out)
        return out

    def encode(self, text: str) -> bytes:
        get, out = self.__getitem__, []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(get, self.runs.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def token_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string), a row per row of docs; ids are little-endian unsigned 32-bit numbers. A null text counts as empty and has no ids."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return plain_docs(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): token_ids, digested where they are made so that ids don't leave the task."""

    def run(batches):
        bpe = encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                rows.append((len(ids) // 4, sha(ids), sha(bpe.decode(ids).encode())))
            n, ids_sha, decoded_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain_docs(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
