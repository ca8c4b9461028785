"""Source divergences, hard negatives and odd sketches against brute-force versions."""

import collections
import itertools
import os
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import hard_negatives, near_links, odd_sketches, queries, source_divergence

from .cases import documents, frame, words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hard_negatives"])
def test_queries_agree_with_sql(spark, duck, name):
    want = duck.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, FOLDER).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


# ---------------------------------------------------------------- 11


def _audited(rows, least=30, top=50):
    """The audit of (text, lang, source) by counting, with fractions."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans(source_divergence.UPPER, source_divergence.LOWER)
    terms = [re.findall(source_divergence.TERM, t.translate(lower)) for t, *_ in rows]
    out = []
    for lang in {x for _, x, _ in rows}:
        own = [(t, s) for t, (_, x, s) in zip(terms, rows, strict=True) if x == lang]
        docs = collections.Counter(w for t, _ in own for w in set(t))
        kept = {w for w, n in docs.items() if n >= least}
        counts = collections.defaultdict(collections.Counter)
        for t, s in own:
            counts[s].update(w for w in t if w in kept)
        whole = sum(counts.values(), collections.Counter())
        share = lambda c: {w: 1 + int(Fraction(10**9 * (c[w] + 5), sum(c.values()) + 5 * len(kept))) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in counts if o != s]
            found = [(p[s][w] - q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", found, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergences(spark, monkeypatch):
    """Over small blocks and slices, with null columns, empty texts, chunks of many terms, and terms whose documents the counts of chunks leave open."""
    r = random.Random(5)
    shapes = ("{}", "{}.", "({})", "{}!", "X-{}", "{}/{}", "{0}\u00a0{0}", "\u00c9{}")
    rows = [(" ".join(r.choice(shapes).replace("{0}", "{}").format(*[f"W{chr(97 + r.randrange(20))}"] * 2) for _ in range(r.randrange(12))), r.choice(("en", "de", None, "")), r.choice(("s1", "s2", None, "s3", "s4"))) for _ in range(900)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("one", "it", "s1"), ("y" * 40000 + "\t1 2,3", "en", "s1")] + rows[:3]
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 2000)
    monkeypatch.setattr(source_divergence, "TERM_BLOCK", 7)
    monkeypatch.setattr(source_divergence, "SOURCE_BLOCK", 2)
    df = spark.createDataFrame([(*x, "kept") for x in rows], "text string, lang string, source string, term string").repartition(3)
    for most in (2_000_000, 0):
        monkeypatch.setattr(source_divergence, "BROADCAST_ROWS", most)
        for least in (30, 170):
            got = source_divergence.audit(df, least_docs=least).collect()
            assert sorted(map(tuple, got)) == _audited(rows, least)
    assert source_divergence.audit(df.limit(0)).collect() == []


def test_slices_go_before_the_next_one_is_factored(monkeypatch):
    """Nothing of a slice is held when the next one takes its memory."""
    import weakref

    import pyarrow as pa

    held = []

    class Watched(source_divergence._Factored):
        def __init__(self, *columns):
            assert not [x for x in held if x() is not None]
            held.append(weakref.ref(self))
            super().__init__(*columns)

    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 100)
    monkeypatch.setattr(source_divergence, "_Factored", Watched)
    batch = pa.RecordBatch.from_pydict({"text": [words(i, 30) for i in range(9)], "lang": ["en"] * 9, "source": ["s"] * 9})
    rows = [sum(x.num_rows for x in source_divergence._factored([batch, batch], 0, least)) for least in (None, 30)]
    assert len(held) == 36 and rows[0] == rows[1] > 300


# ---------------------------------------------------------------- 12


def _mined(rows):
    """Hard negatives by sorting all rows for each anchor."""
    own = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for n, i, label, v in own:
        if i is None or i % 50:
            continue
        ranked = sorted(((-sum(a * b for a, b in itertools.zip_longest(v, w, fillvalue=0)), j is None, j or 0, m, other) for m, j, other, w in own if m != n))
        for score, none, j, _, _ in [x for x in ranked if x[4] == label][:5]:
            fits = [x for x in ranked if x[4] != label and 50 * -score <= 100 * -x[0] <= 95 * -score]
            out += [(i, None if none else j, rank, None if x[1] else x[2], -score, -x[0]) for rank, x in enumerate(fits[:3], 1)]
    return sorted(out, key=str)


def test_hard_negatives(spark, monkeypatch):
    """Small blocks and groups; null and repeated ids, vectors that take no part, ties, short and zero vectors, negative scores."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(4, 12))
    rows = []
    for i in range(700):
        v = centres[i % 4] * r.random() + r.normal(size=12) * 0.3
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(i % 3 if i % 5 else r.integers(0, 9))))
    rows += [(None, rows[3][1], 2), (50, rows[4][1], 1), (50, rows[4][1], 1), (750, None, 1), (751, rows[5][1], None), (800, [0.0] * 12, 1), (850, [], 2), (900, rows[6][1][:5], 0), (901, [1.0, None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 1), (950, [-x for x in rows[0][1]], 77), (1000, rows[2][1], 77), (1001, rows[2][1], 77)]
    rows += [(1100 + i, rows[8][1], i % 3) for i in range(40)]
    df = spark.createDataFrame([(*x, "kept", 1) for x in rows], "vec_id long, embedding array<float>, label int, rows string, block int").repartition(4)
    want = _mined(rows)
    assert len(want) > 100
    for block, asked, strip, levels in ((2048, 8192, 256, None), (64, 3, 5, ((0.9, None), (0.1, 1.0)))):
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
        monkeypatch.setattr(hard_negatives, "LABEL_ROWS", block // 2)
        monkeypatch.setattr(hard_negatives, "ASKED", asked)
        monkeypatch.setattr(hard_negatives, "STRIP", strip)
        if levels:
            monkeypatch.setattr(hard_negatives, "POSITIVE_LEVELS", levels[0])
            monkeypatch.setattr(hard_negatives, "NEGATIVE_WIDTHS", levels[1])
        assert sorted(map(tuple, hard_negatives.mine(df).collect()), key=str) == want
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_candidates_lose_no_pair_and_skip_most():
    r = np.random.default_rng(1)
    rows = np.floor(256 * r.normal(size=(500, 64)) / 8)
    rows[:50] = np.floor(rows[50:100] * 0.9)
    asked = rows[:60]
    low = np.full(60, 0.7 * 65536)
    a, y = hard_negatives.candidates(asked, low, rows)
    found = set(zip(a.tolist(), y.tolist(), strict=True))
    scores = asked @ rows.T
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(scores >= low[:, None]), strict=True)} <= found
    assert len(found) < 0.05 * scores.size


def test_scores_of_any_size_are_exact():
    big = np.array([[2.0**70, 3.0], [2.0**30, -5.0]])
    assert hard_negatives.exact(big, np.array([[1.0, 1.0], [2.0**30, 7.0]])).tolist() == [1 << 62, 2**60 - 35]


# ---------------------------------------------------------------- 13


def _set(text, n=4):
    parts = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))) if parts else frozenset()


def _linked_rows(rows):
    """(id, n_shingles, component, kept) of (id, text) by comparing all pairs of sets."""
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[_set(t)].append(i)
    names = [s for s in sets if s]
    up = list(range(len(names)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(names)), 2):
        x, y = names[a], names[b]
        if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            up[root(a)] = root(b)
    least = {}
    for n, s in enumerate(names):
        ids = [i for i in sets[s] if i is not None]
        if ids:
            least[root(n)] = min([*ids, least.get(root(n), ids[0])])
    of = {s: least.get(root(n)) for n, s in enumerate(names)}
    out = []
    for i, t in rows:
        s = _set(t)
        c = of[s] if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def _clusters():
    """Classes of near copies: one around a text, a chain whose ends are unlike, and two whose members differ by about 0.75 from each other's."""
    rows, r = [], np.random.default_rng(9)
    base = words(70, 300).split(" ")

    def changed(parts, n):
        parts = list(parts)
        for at in r.choice(len(parts), n, replace=False):
            parts[at] = f"changed{r.integers(1 << 30)}"
        return parts

    rows += [" ".join(changed(base, r.integers(1, 4))) for _ in range(40)]
    chain = words(71, 200).split(" ")
    for _ in range(12):
        chain = changed(chain, 4)
        rows.append(" ".join(chain))
    one = words(72, 240).split(" ")
    two = changed(one, 9)
    rows += [" ".join(changed(x, 1)) for x in (one, two) for _ in range(25)]
    rows += [words(800 + i, 60) + " " + " ".join(base[:40]) for i in range(60)]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_by_odd_sketches(spark, monkeypatch, block):
    monkeypatch.setattr(near_links, "BLOCK", block)
    monkeypatch.setattr(near_links, "PARTS", min(block, 64))
    rows = _clusters() + [(1000 + i, t) for i, t, *_ in documents() if i is not None] + [(None, rows_text) for rows_text in (words(70, 300), "only here null")]
    got = odd_sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == _linked_rows(rows)


def test_near_duplicates_take_all_cases(spark):
    got = odd_sketches.near_duplicates(frame(spark)).collect()
    assert sorted(map(tuple, got), key=str) == _linked_rows([(r[0], r[1]) for r in documents()])
    assert odd_sketches.near_duplicates(frame(spark, [])).collect() == []


def test_bitmaps_estimate_similarity():
    """Estimates from bitmaps against true similarities, and no pair of 0.8 beyond the bound or without a shared band."""
    r = np.random.default_rng(2)
    ones, want, keys = [], [], 0
    for n in range(400):
        both = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        share = 0.8 if n % 2 else r.uniform(0.3, 0.99)
        apart = round(400 * (1 - share) / (1 + share))
        x, y = both, np.r_[both[apart:], r.integers(0, 1 << 63, apart, dtype=np.uint64)]
        bands, bits = odd_sketches.sketches(np.array([odd_sketches.samples(x), odd_sketches.samples(y)]))
        ones.append(int(np.bitwise_count(bits[0] ^ bits[1]).sum()))
        want.append((400 - apart) / (400 + apart))
        keys += n % 2 and not (bands[0] == bands[1]).any()
    ones, want = np.array(ones), np.array(want)
    mean, off = odd_sketches.differing(0.8)
    at = ones[1::2]
    assert abs(at.mean() - mean) < off / 2 and 0.6 * off < at.std() < 1.3 * off
    assert (at <= mean + odd_sketches.SIGMAS * off).all() and not keys
    x, y = r.integers(0, 1 << 63, (2, 300), dtype=np.uint64)
    for n in (0, 10, 150, 300):
        z = np.r_[x[n:], y[:n]]
        assert np.bitwise_count(odd_sketches.parities(x) ^ odd_sketches.parities(z)).sum() <= 2 * n
    wrong = np.abs(odd_sketches.similarity(ones) - want)
    assert wrong[want > 0.9].mean() < wrong[want < 0.6].mean() < 0.1
    assert (ones[want < 0.4] > mean + odd_sketches.SIGMAS * off).mean() > 0.8
