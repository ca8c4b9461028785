"""WebP, quality votes, packing, page wrappers, BPE and the pipeline against brute-force versions and the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe_prefix, packing, page_wrapper, quality_knn, webp_media
from corpusloom.llm.queries import vocabulary

from .cases import documents, frame, words

# ---------------------------------------------------------------- 3


class Writer:
    """A plain bit writer for pictures that use the format's rarer parts."""

    def __init__(self):
        self.bits, self.n = 0, 0

    def put(self, value, size):
        self.bits |= value << self.n
        self.n += size

    def data(self):
        return self.bits.to_bytes(-(-self.n // 8), "little")

    def flat_code(self, symbols, used):
        """A code in which the first 2**k symbols have k bits each."""
        k = used.bit_length() - 1
        self.put(0, 1)
        order = webp_media.CODE_ORDER
        own = {0: 1, k: 1}
        self.put(order.index(k) + 1 - 4 if order.index(k) >= 4 else 0, 4)
        for s in order[: max(4, order.index(k) + 1)]:
            self.put(own.get(s, 0), 3)
        self.put(0, 1)
        for s in range(symbols):
            self.put(1 if s < used else 0, 1)

    def symbol(self, s, k):
        self.put(int(f"{s:0{k}b}"[::-1], 2), k)

    def group(self, cache=0):
        self.flat_code(256 + 24 + cache, 512 if cache else 256)
        for _ in range(3):
            self.flat_code(256, 256)
        self.put(0b0001, 4)

    def pixels(self, argb, cache=0):
        for p in argb:
            self.symbol(p >> 8 & 255, 9 if cache else 8)
            for s in (16, 0, 24):
                self.symbol(p >> s & 255, 8)

    def small(self, argb):
        self.put(0, 1)
        self.group()
        self.pixels(argb)

    def head(self, wide, high):
        self.put(0x2F, 8)
        self.put(wide - 1, 14)
        self.put(high - 1, 14)
        self.put(0, 4)


def _channels(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def _argb(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _guess(mode, left, top, right, corner):
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clip = lambda v: max(0, min(255, v))
    table = {0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right), 10: half(half(left, corner), half(top, right))}
    if mode in table:
        return table[mode]
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    return [clip(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner, strict=True)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    r = random.Random(mode)
    wide, high = 7, 6
    picture = [[_argb([r.randrange(256) for _ in range(4)]) for _ in range(wide)] for _ in range(high)]
    rest = []
    for y in range(high):
        for x in range(wide):
            at = lambda j, i: _channels(picture[j][i])
            if not y:
                guess = at(0, x - 1) if x else [255, 0, 0, 0]
            elif not x:
                guess = at(y - 1, 0)
            else:
                guess = _guess(mode, at(y, x - 1), at(y - 1, x), at(y - 1, x + 1) if x + 1 < wide else at(y, 0), at(y - 1, x - 1))
            rest.append(_argb([(a - b) % 256 for a, b in zip(at(y, x), guess, strict=True)]))
    w = Writer()
    w.head(wide, high)
    w.put(1 | webp_media.PREDICTOR << 1 | 0 << 3, 6)
    w.small([mode << 8] * 4)
    w.put(0, 3)
    w.group()
    w.pixels(rest)
    assert webp_media.read_pictures([w.data()])[0].tolist() == picture


def test_colour_transforms():
    r = random.Random(5)
    wide, high, factors = 5, 4, [0x00F31A2B, 0x00057F80]
    picture = [_argb([255, *(r.randrange(256) for _ in range(3))]) for _ in range(wide * high)]
    signed = lambda v: v - 256 if v > 127 else v
    share = lambda f, c: signed(f) * signed(c) >> 5
    crossed = []
    for i, p in enumerate(picture):
        a, red, green, blue = _channels(p)
        f = factors[(i % wide) >> 2]
        crossed.append(_argb([a, (red - share(f & 255, green)) % 256, green, (blue - share(f >> 8 & 255, green) - share(f >> 16 & 255, red)) % 256]))
    coded = []
    for p in crossed:
        a, red, green, blue = _channels(p)
        coded.append(_argb([a, (red - green) % 256, green, (blue - green) % 256]))
    w = Writer()
    w.head(wide, high)
    w.put(1 | webp_media.CROSS_COLOUR << 1 | 0 << 3, 6)
    w.small(factors)
    w.put(1 | webp_media.SUBTRACT_GREEN << 1, 3)
    w.put(0, 3)
    w.group()
    w.pixels(coded)
    assert webp_media.read_pictures([w.data()])[0].ravel().tolist() == picture


def test_code_groups_and_cache_and_long_distances():
    """Two groups of codes by block, cache hits, and a reference over many rows, beside a plain picture in lockstep."""
    r = random.Random(9)
    wide, high = 8, 40
    own = [_argb([255, *(r.randrange(256) for _ in range(3))]) for _ in range(wide * 20)]
    w = Writer()
    w.head(wide, high)
    w.put(0, 1)
    w.put(1 | 8 << 1, 5)
    w.put(1 | 0 << 1, 4)
    w.small([(i % 2) << 8 for i in range(2 * 10)])
    for _ in range(2):
        w.flat_code(256 + 24 + 256, 512)
        for _ in range(3):
            w.flat_code(256, 256)
        w.flat_code(40, 32)
    first = own.copy()
    slot = own[3] * webp_media.CACHE_FACTOR % (1 << 32) >> 24
    kept = [i for i in range(len(own)) if own[i] * webp_media.CACHE_FACTOR % (1 << 32) >> 24 == slot][-1]
    w.pixels(first, 1)
    w.symbol(280 + slot, 9)
    # the rest: one reference of the length still missing, over 160 + 1 pixels
    length, distance = wide * high - len(own) - 1, len(own) + 1
    for value, base, bits in ((length, 256, 9), (distance + 120, 0, 5)):
        code, extra, more = (int(x) for x in webp_media.prefix_of(value))
        w.symbol(base + code, bits)
        w.put(more, extra)
    plain = webp_media.write_pictures(np.frombuffer(b"abc" * 64 * 3, np.uint8), np.array([0, 576]))[0]
    picture, other = webp_media.read_pictures([w.data(), plain])
    line = own + [own[kept]]
    line = (line * 3)[: wide * high]
    assert picture.ravel().tolist() == line
    assert set(other.ravel().tolist()) == {0xFF616263}


def test_short_distances():
    near = webp_media.near_offsets()
    assert len(near) == 120
    assert near[:8].tolist() == [[0, 1], [1, 0], [1, 1], [-1, 1], [0, 2], [2, 0], [1, 2], [-1, 2]]
    assert near[-1].tolist() == [8, 7]


def test_texts_round_trip_as_pictures(spark):
    got = {r["doc_id"]: r for r in webp_media.read_back(webp_media.store(frame(spark))).collect()}
    for i, t, *_ in documents()[:16]:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(raw), len(payload))
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
    arrays = webp_media.pixel_arrays(webp_media.store(frame(spark, documents()[4:5]))).first()
    assert arrays["height"] * arrays["width"] * 3 == len(arrays["pixels"])
    assert webp_media.read_back(webp_media.store(frame(spark, []))).collect() == []


def test_pictures_are_read_by_codes_and_not_by_pixels(monkeypatch):
    """Copied pixels, and places of the cache that copies fill, are found for all pictures at once; a step takes a whole reference."""
    codes, found = [], webp_media._pixels_of
    monkeypatch.setattr(webp_media, "_pixels_of", lambda lane, *rest: (codes.append(len(lane)), found(lane, *rest))[1])
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 256, 192, np.uint8).tobytes() for _ in range(3)]
    texts = [b"", b"x", b"ab" * 9000, b"".join(lines[i] for i in rng.integers(0, 3, 90))]
    # pixels of forty colours in any order: literals, hits, runs of hits and runs of copies
    texts += [b"".join(bytes([c, c ^ 7, 3 * c & 255]) * int(n) for c, n in zip(rng.integers(0, 40, m), rng.integers(1, 9, m), strict=True)) for m in (5, 60, 700)]
    files = webp_media.write_files(texts)
    for text, (payload, _) in zip(texts, webp_media._pixels(files), strict=True):
        assert payload == text + b" " * (-len(text) % 192 if text else 192)
    assert max(codes) < sum(max(len(t), 1) for t in texts) / 3 / 2


def test_files_are_read_back_by_the_worker_that_wrote_them(spark):
    """With the rows of two passes, and one pass of Python: another one holds its own worker in each task."""
    from corpusloom.llm import queries

    rows = sorted(webp_media.stored_and_read(frame(spark)).collect(), key=str)
    assert rows == sorted(webp_media.read_back(webp_media.store(frame(spark))).collect(), key=str)
    assert webp_media.stored_and_read(frame(spark, [])).collect() == []
    df = queries.op3_webp_media(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


# ---------------------------------------------------------------- 4


def test_quality_votes_separate_held_out_rows(spark):
    r = random.Random(3)
    rows = [(i, " ".join(("XX!!" if i % 4 == 0 else "word") + str(r.randrange(99)) for _ in range(60))) for i in range(300)] + [(400, None), (None, "word1 word2")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = quality_knn.score(docs, labels).collect()
    assert len(got) == len(rows)
    for row in got:
        if row["doc_id"] is not None and row["doc_id"] < 300:
            assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
            assert row["predicted"] == int(row["doc_id"] % 4 != 0)
        assert 0 <= row["score"] <= 1
    kept = quality_knn.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r["score"] for r in kept.collect()} == {"clash"}
    assert {r["score"] for r in quality_knn.score(docs, labels.limit(0)).collect()} == {0.5}


def test_votes_are_exact():
    g = np.random.default_rng(0)
    known = g.standard_normal((50, 8)).astype(np.float32)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    labels = (g.random(50) > 0.5).astype(np.float32)
    asked = known[:5] + 0.1
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    for x, got in zip(asked, quality_knn.vote(asked, known, labels, 7), strict=True):
        near = np.argsort(-(known @ x))[:7]
        weight = np.maximum(known[near] @ x, 1e-6) ** quality_knn.SHARPNESS
        assert abs(got - (weight * labels[near]).sum() / weight.sum()) < 1e-5


# ---------------------------------------------------------------- 5 and 10


ODD = ["<|endoftext|> a<|ENDOFTEXT|>b", "don't  we'll\t\n\n x", "日本語 ééé ٣٤ ½ a\x1cb \x85 c　d", "aaaaaaaaaaaaaaaa   \n", "''s 's ,. !!, x", "İΣσς ÉÀ. É, "]


def _random_texts(n):
    r = random.Random(4)
    letters = list("aBé.,!  \n'sÉß0_-<|>İΣ×tμ") + [". ", ", ", "<|endoftext|>", "\x1c", "日", "the ", " of"]
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_prefix_encoder_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [t or "" for _, t, *_ in documents()] + ODD + _random_texts(1500)
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    got = {r["doc_id"]: r for r in bpe_prefix.digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = documents()[:16] + [(50 + i, t, "en", "s", 0, 0.0, "", 0, 0) for i, t in enumerate(ODD + _random_texts(200))]
    got = packing.packed(frame(spark, rows), path).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert len(pieces) == -(-len(ids) // 4096)
        for n, p in enumerate(pieces):
            part = ids[4096 * n : 4096 * n + 4096]
            assert (p["piece"], p["start"], p["length"]) == (n, 4096 * n, len(part))
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.packed(frame(spark, []), path).collect() == []


def test_words_are_coded_as_the_library_codes_texts():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), packing.WordIds(path), random.Random(11)
    parts = ["a", "B", "é", "É", "ß", "İ", "ſ", "'s", "'t", "1", "٣", "²", " ", "  ", "\n", ". ", ", ", ".", ",", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "日", "本", "\u0301", "Å", "<|endoftext|>", "<|", "-", "_", "😀", "\0", "ǅ", "ﬁ", "Σ", "ς", "word", "x" * 70]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(2000)] + [words(5, 3000)]
    for _ in range(2):  # the second time from memory
        ids, places = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(places, places[1:], strict=False)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError, match="lower case"):
        packing.WordIds(vocabulary("byte_bpe_50k.json"))


def test_least_bins_bounds_every_packing():
    def fewest(sizes, room):
        best = len(sizes)

        def place(at, fills):
            nonlocal best
            if len(fills) >= best:
                return
            if at == len(sizes):
                best = len(fills)
                return
            for b in range(len(fills)):
                if fills[b] + sizes[at] <= room:
                    place(at + 1, [*fills[:b], fills[b] + sizes[at], *fills[b + 1 :]])
            place(at + 1, [*fills, sizes[at]])

        place(0, [])
        return best

    r = random.Random(3)
    for _ in range(150):
        sizes = [r.randrange(1, 21) for _ in range(r.randrange(1, 8))]
        least, exact = packing.least_bins(sizes, 20), fewest(sizes, 20)
        assert least <= exact <= len(packing.local_search(packing.best_fit(sizes, 20), sizes, 20))
    assert packing.least_bins([11, 11, 11], 20) == 3


def test_local_search_empties_bins():
    # best fit leaves three bins where two are enough
    sizes = [5, 4, 3, 3, 3, 2]
    bins = packing.local_search([[0, 2], [1, 3], [4, 5]], sizes, 10)
    assert len(bins) == 2
    assert sorted(i for b in bins for i in b) == list(range(6))
    assert all(sum(sizes[i] for i in b) <= 10 for b in bins)
    for seed in range(20):
        r = random.Random(seed)
        sizes = [r.randint(1, 60) for _ in range(80)]
        before = packing.best_fit(sizes, 100)
        after = packing.local_search([b.copy() for b in before], sizes, 100)
        assert len(after) <= len(before)
        assert sorted(i for b in after for i in b) == list(range(80))
        assert all(sum(sizes[i] for i in b) <= 100 for b in after)


# ---------------------------------------------------------------- 9


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p><article>no</article>";</script></head><body>
<header class=top>Site</header><nav><ul><li><a href=/a>A {i}</a><li><a href=/b>B</a></ul></nav><div class="cookie notice">We use cookies</div>
<article><h1>Title &amp; more {i}</h1><p>First   <b>bold
 text</b> {i}<p>Second &#233;<script>x()</script><br>line</p><form><p>Sign up</p></form><div class="comments"><p>Reader says</p></div><ul><li>one<li>two</ul></article>
<aside>Side {i}</aside><footer>&copy; me</footer></body></html>"""


def test_main_texts(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(8)]
    rows += [(20, "http://plain.example/x", "<div><p>Only this</p></div>"), (21, None, None), (22, "http://h.example/x", ""), (0, "http://h.example/0", PAGE.replace("{i}", "0"))]
    got = page_wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i in range(8):
        assert by[i]["text"] == f"Title & more {i}\nFirst bold text {i}\nSecond é line\none\ntwo"
        assert by[i]["n_chars"] == len(by[i]["text"])
    assert by[20]["text"] == "Only this"
    assert by[21]["text"] == by[22]["text"] == ""


DIVS = """<html><body><div class="box"><a href=/x>Home</a> <a href=/y>News</a></div><div class="text"><h2>About {i}</h2><p>Some words that differ: {w}</p></div><div class="end">All rights reserved by the owner of this site</div></body></html>"""


def test_wrappers_find_the_slot_without_names(spark):
    pages = [(i, f"http://d.example/{i}", DIVS.replace("{i}", str(i)).replace("{w}", words(i, 40))) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in page_wrapper.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, *_ in pages:
        assert got[i] == f"About {i}\nSome words that differ: {words(i, 40)}"


def _texts(spark, page, n=8):
    pages = [(i, f"http://e.example/{i}", page.replace("{i}", str(i)).replace("{w}", words(i, 40))) for i in range(n)]
    got = page_wrapper.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_wrappers_take_template_nodes_out_of_articles(spark):
    page = """<html><body><nav>x</nav><article><h1>T {i}</h1><div class="zz-box"><p>Join our club today</p></div><div class="body"><p>{w}</p><p>Thanks.</p></div><ul><li>one</ul></article></body></html>"""
    assert _texts(spark, page) == [f"T {i}\n{words(i, 40)}\nThanks.\none" for i in range(8)]
    # the same article under other navigation is no template
    page = """<html><body><div class="top">{i}</div><article><div class="body"><p>All of the text</p></div></article></body></html>"""
    assert all("All of the text" in t for t in _texts(spark, page))


def test_wrappers_keep_all_slots(spark):
    page = """<html><body><div class="page"><h1>Title {i}</h1><div class="lead">Lead {i}</div><div class="body"><p>{w}</p></div></div><div class="end">All rights reserved</div></body></html>"""
    assert _texts(spark, page) == [f"Title {i}\nLead {i}\n{words(i, 40)}" for i in range(8)]


def test_all_articles_of_a_page_are_joined(spark):
    page = """<html><body><article>Part one {i} {w}</article><div class="ad">Buy</div><article>Part two {i}</article><aside><article>Teaser {i}</article></aside></body></html>"""
    want = [f"Part one {i} {words(i, 40)}\nPart two {i}" for i in range(8)]
    assert _texts(spark, page) == want
    assert _texts(spark, page, 1) == want[:1]


def _outlined(page):
    return page_wrapper.outline(page_wrapper.tree(page))


def test_tree_matching():
    a, b = map(_outlined, ("<div><p>a</p><ul><li>x</ul></div>", "<div><h1>t</h1><p>b</p><ul><li>y<li>z</ul></div>"))
    matching = page_wrapper.Matching(a, b)
    pairs = matching.pairs()
    assert matching.size() == len(pairs) == 5
    assert [(a.labels[x], b.labels[y]) for x, y in pairs].count(("p", "p")) == 1


def test_tree_matching_is_the_largest():
    """Against the plain recurrence over all pairs of children, on small random trees."""
    r = random.Random(2)

    def grown(depth):
        return "".join(f"<{t}>{grown(depth - 1) if depth else ''}</{t}>" for t in (r.choice(["div", "b", "i"]) for _ in range(r.randint(0, 3))))

    def largest(a, b, i=0, j=0):
        if a.labels[i] != b.labels[j]:
            return 0
        best = [[0] * (len(b.kids[j]) + 1) for _ in range(len(a.kids[i]) + 1)]
        for x, p in enumerate(a.kids[i], 1):
            for y, q in enumerate(b.kids[j], 1):
                best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + largest(a, b, p, q))
        return best[-1][-1] + 1

    for _ in range(300):
        a, b = _outlined(grown(3)), _outlined(grown(3))
        matching = page_wrapper.Matching(a, b)
        pairs = matching.pairs()
        assert matching.size() == len(pairs) == len(set(pairs)) == largest(a, b)
        assert all(a.labels[x] == b.labels[y] and (not x or (a.parent[x], b.parent[y]) in pairs) for x, y in pairs)


def _inline(r):
    return "<p>" + "".join(f"<{t}>x</{t}>" for t in (r.choice(["a", "b", "i", "em", "code"]) for _ in range(r.randint(0, 7)))) + "</p>"


def test_many_distinct_siblings_are_weighed():
    """Over 65,536 pairs of distinct structures: the match is the largest, not any of equal labels."""
    r = random.Random(9)
    some = list({_inline(r): 0 for _ in range(620)})
    a, b = (_outlined("<div>" + "<h2>t</h2>".join(x) + "</div>") for x in (some, [_inline(r), *(x for n, x in enumerate(some) if n % 9), _inline(r)]))

    def common(x, y, of):
        best = [0] * (len(y) + 1)
        for p in x:
            before = list(best)
            for n, q in enumerate(y, 1):
                best[n] = max(best[n - 1], before[n], before[n - 1] + of(p, q))
        return best[-1]

    left, right = ([(o.labels[k], [o.labels[c] for c in o.kids[k]]) for k in o.kids[1]] for o in (a, b))
    assert len({a.shape[k] for k in a.kids[1]}) * len({b.shape[k] for k in b.kids[1]}) > 1 << 16
    known = {}

    def size(x, y):
        if x[0] != y[0]:
            return 0
        key = (*x[1], "", *y[1])
        if key not in known:
            known[key] = 1 + common(x[1], y[1], lambda p, q: int(p == q))
        return known[key]

    matching = page_wrapper.Matching(a, b)
    assert len(matching.pairs()) == matching.size() == 2 + common(left, right, size)


def test_weights_by_rows_are_the_largest(monkeypatch):
    r = random.Random(3)

    def grown(depth):
        return "".join(f"<{t}>{grown(depth - 1) if depth else ''}</{t}>" for t in (r.choice(["div", "b", "i"]) for _ in range(r.randint(0, 3))))

    for cells in (1 << 22, 4):
        for _ in range(150):
            a, b = _outlined(grown(3)), _outlined(grown(3))
            plain = page_wrapper.Matching(a, b).size()
            with monkeypatch.context() as m:
                m.setattr(page_wrapper, "WEIGHED", 0)
                m.setattr(page_wrapper, "CELLS", cells)
                matching = page_wrapper.Matching(a, b)
                assert len(matching.pairs()) == matching.size() == plain


def test_text_beside_odd_markup(spark):
    """An empty svg, a lone quote and an empty comment take nothing of the text after them; xmp is shown as it stands."""
    page = """<html><body><article><p>One {i} <svg class="s"/>two {w}</p><p title=it's>Don't {i} stop</p><!--><p>Seen {i}</p><!-- not --!><xmp>&lt;b {i}></xmp></article><svg><title>no</title></svg></body></html>"""
    assert _texts(spark, page) == [f"One {i} two {words(i, 40)}\nDon't {i} stop\nSeen {i}\n&lt;b {i}>" for i in range(8)]


def test_alignments_in_halves_are_as_heavy(monkeypatch):
    r = random.Random(4)
    weight = np.array([[3, 0, 1], [0, 2, 0], [1, 0, 5]])
    for _ in range(50):
        x, y = ([r.randrange(3) for _ in range(r.randrange(30))] for _ in "ab")
        whole = page_wrapper.aligned(x, y, weight)
        with monkeypatch.context() as m:
            m.setattr(page_wrapper, "CELLS", 4)
            halved = page_wrapper.aligned(x, y, weight)
        assert sum(weight[x[a], y[b]] for a, b in whole) == sum(weight[x[a], y[b]] for a, b in halved)
        assert all(a < c and b < d for (a, b), (c, d) in zip(halved, halved[1:], strict=False))


def test_deep_pages(spark):
    deep = ["<html><body>" + start * 5000 + "text {i} of {w}" + end * 5000 for start, end in (("<div>", "</div>"), ("<font>", ""), ("<ul><li>", ""))]
    for page in deep:
        assert _texts(spark, page, 6) == [f"text {i} of {words(i, 40)}" for i in range(6)]
        assert _texts(spark, page, 1) == [f"text 0 of {words(0, 40)}"]


def test_many_siblings_are_aligned_fast():
    import time

    r = random.Random(6)
    page = lambda n: "<html><body>" + "".join(f"<h2>{i}</h2><p>{i} {'<em>e</em>' * r.randint(0, 3)}</p>" for i in range(n)) + "</body></html>"
    a, b = _outlined(page(2000)), _outlined(page(1990))
    start = time.process_time()
    assert len(page_wrapper.Matching(a, b).pairs()) >= 2 * 1990
    # 49 s when all pairs of siblings are matched
    assert time.process_time() - start < 4


def test_forms_around_the_text(spark):
    """Pages whose server puts all of them into a form; a form beside the text stays out."""
    page = """<html><body><form action="/{i}"><div class="menu">Home {i}</div><article><h1>Title {i}</h1><p>{w}</p></article><input></form><form><label>Search</label></form></body></html>"""
    want = [f"Title {i}\n{words(i, 40)}" for i in range(8)]
    assert _texts(spark, page) == want
    assert _texts(spark, page, 1) == want[:1]
    bare = """<html><body><form><div id="menu">Home</div><div class="page"><h1>Title {i}</h1><p>{w}</p></div></form><form>Log in</form></body></html>"""
    assert _texts(spark, bare) == want
    login = """<html><body><div class="nav">Home</div><form><label>User</label><label>Word</label></form></body></html>"""
    assert _texts(spark, login) == [""] * 8
    assert _texts(spark, login, 1) == [""]


def test_names_of_chrome_around_the_text(spark):
    """A name doesn't overrule text that varies from page to page, unless it is beside the text."""
    page = """<html><body><div class="nav">Home</div><div class="search-results-study"><h1>Title {i}</h1><p>{w}</p></div><div class="comments">nice {i} {w} {w} {w} {w} {w} {w} {w}</div></body></html>"""
    want = [f"Title {i}\n{words(i, 40)}" for i in range(8)]
    assert _texts(spark, page) == want
    beside = """<html><body><article><h1>Title {i}</h1><div class="promo">Buy {i}</div><p>{w}</p></article><div class="related"><article>Teaser {i}</article></div></body></html>"""
    assert _texts(spark, beside) == want


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        text = " ".join(("XX!!" if bad else "word") + str(r.randrange(999)) for _ in range(80))
        rows.append((i, text + ("\nShared footer line of all sites" if i % 2 else "") + ('\npassword="abcdefghij123456"' if i == 9 else ""), "en", f"s{i % 7}", 0, "kept"))
    rows += [(300 + i, rows[1][1], "en", "s1", 0, "kept") for i in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string"
    docs = spark.createDataFrame(rows, schema)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, folder)
        out.write.parquet(f"{folder}/{n}")
        at = spark.read.parquet(f"{folder}/{n}")
        seen[name] = at.toPandas()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
            assert set(seen[name]["n_lines"]) == {"kept"}
    assert set(seen["quality classifier"]["doc_id"]) == {i for i, *_ in rows if i >= 300 or i % 4}
    assert not seen["line dedup"]["text"].str.contains("Shared footer").any()
    left = set(seen["SimHash near-dedup"]["doc_id"])
    assert 1 in left
    assert not left & {300, 301, 302, 303, 304}
    assert not seen["secret scans"]["text"].str.contains("abcdefghij123456").any()
    assert (seen["secret scans"]["n_chars"] == seen["secret scans"]["text"].str.len()).all()
    assert set(seen["best-fit packing"]["doc_id"]) == left
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(whole["ids_crc32"]) == sorted(seen["best-fit packing"]["ids_crc32"])
