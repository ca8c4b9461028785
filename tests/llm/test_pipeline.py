"""Each stage of the pipeline, as composed, on what the stages before it kept, against brute force."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import quality_knn
from corpusloom.llm.queries import vocabulary

from .cases import words
from .test_documents import _linked, _without_boilerplate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def _documents():
    r = np.random.default_rng(12)
    rows = []
    for i in range(150):
        text = words(3000 + i, 90) if i % 5 else " ".join(f"{'!?#' * (1 + i % 3)}XX{r.integers(99)}" for _ in range(60))
        text += "\nRead more on our pages\nAll rights reserved" if i % 3 == 0 else ""
        text += f"\nlogin: robot{i}\npassword: pw{i}word\nhost https://db{i}.example.org/x" if i % 7 == 1 else ""
        rows.append((i, text))
    for k in range(12):
        parts = rows[2 * k + 1][1].split(" ")
        for at in r.choice(len(parts), 1 + k % 6, replace=False):
            parts[at] = f"changed{k}"
        rows.append((200 + k, " ".join(parts)))
    rows += [(300, rows[1][1]), (301, rows[1][1]), (None, words(1, 50)), (302, None), (303, ""), (304, "   "), (305, words(9, 5000))]
    return [(i, t, "en", f"s{n % 9}", None if t is None else len(t), "kept") for n, (i, t) in enumerate(rows)]


def _shingles(text):
    parts = text.lower().split()
    return frozenset(tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))) if parts else frozenset()


def _one_of_each(rows):
    """(id, text) of the rows that stay: of each class of similar sets that with the least id."""
    sets = [_shingles(t or "") for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    groups = {}
    for n, row in enumerate(rows):
        groups.setdefault(root(n), []).append(row)
    return sorted((min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()), key=str)


def _masked(text):
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in _linked(text).split(",") if s):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_each_stage_against_brute_force(spark, tmp_path):
    folder, rows = str(tmp_path), _documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x["doc_id"], x["text"], x["source"]) for x in at.collect()]
        given = at
        stage(spark, at, folder).write.parquet(f"{folder}/{n}")
        at = spark.read.parquet(f"{folder}/{n}")
        kept[name] = (given, before, at.collect())
    pairs = lambda rows: sorted(((x["doc_id"], x["text"]) for x in rows), key=str)

    given, before, after = kept["quality classifier"]
    scores = quality_knn.score(given, spark.read.parquet(f"{folder}/labels.parquet")).where(F.col("predicted") == 1)
    assert pairs(after) == pairs(scores.collect())
    assert {x["doc_id"] for x in after} >= {i for i in range(150) if i % 5} and not {x["doc_id"] for x in after} & {i for i in range(150) if i % 5 == 0}

    _, before, after = kept["line dedup"]
    want = [(i, t2) for (i, *_), (t2, *_) in zip(before, _without_boilerplate(before), strict=True)]
    assert pairs(after) == sorted(want, key=str)
    assert sum("All rights reserved" in (t or "") for _, t, _ in before) > 30 and not any("All rights reserved" in x["text"] for x in after)
    assert all(x["n_chars"] == len(x["text"]) for x in after)

    _, before, after = kept["SimHash near-dedup"]
    got = pairs(after)
    assert got == _one_of_each([(i, t) for i, t, _ in before])
    assert len(got) <= len(before) - 5

    _, before, after = kept["secret scans"]
    assert pairs(after) == sorted(((i, _masked(t or "")) for i, t, _ in before), key=str)
    assert sum("[SECRET]" in x["text"] for x in after) > 15

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    _, before, after = kept["best-fit packing"]
    want = []
    for i, t, _ in before:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, n, 4096 * n, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for n in range(-(-len(ids) // 4096)) for part in [ids[4096 * n : 4096 * n + 4096]]]
    assert sorted(((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in after), key=str) == sorted(want, key=str)
    sequences = {}
    for x in after:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == [0, *itertools.accumulate(s for _, s in sorted(places))][:-1]
        assert sum(s for _, s in places) <= 4096
    assert len(sequences) <= -(-sum(x[3] for x in want) // 4096) + 1
