"""How the sources of a language differ in their words: exact divergences of smoothed term frequencies.

Texts are factored into chunks between ASCII white space, which no term crosses.
Each batch of documents counts its distinct chunks and the documents that hold
them, every distinct chunk of the corpus is tokenized once, and its terms are
joined back to the batches' chunks: there they give occurrences by source and,
where the counts of chunks leave it open, the distinct documents of a term.
Chunks whose terms can't reach the least number of documents stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, flat, slices, written

#: Fixed values of the audit: terms, smoothing and scale, documents that a kept term has at least, terms reported of a group.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMOOTH, SCALE, LEAST_DOCS, TOP_TERMS = 5, 1_000_000_000, 30, 50
#: Text bytes and rows that are factored at once.
SLICE_BYTES, SLICE_ROWS = 16 << 20, 1 << 15
#: Up to so many hashes of chunks, or a quarter as many terms, are broadcast (about 64 MB); more meet in a shuffle.
BROADCAST_ROWS = 2_000_000
#: Terms and sources of a block whose differences are summed at once.
TERM_BLOCK, SOURCE_BLOCK = 4096, 64

_COUNTED = "lang string, chunk string, n_docs int"
_TOLD = "batch long, lang string, chunk string, docs array<short>, sources array<string>, uses array<int>"


class _Factored:
    """The distinct chunks of each language in some documents, as arrays: row holds a number of language and chunk for each document and chunk of it."""

    def __init__(self, texts: pa.Array, lang: pa.Array):
        chunks = pc.ascii_split_whitespace(texts)
        length = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(chunks.flatten())
        self.names, code = coded.dictionary, np.asarray(coded.indices, np.int64)
        self.languages = pc.dictionary_encode(lang)
        doc = np.repeat(np.arange(len(texts)), length)
        key = (np.asarray(self.languages.indices, np.int64)[doc] * len(self.names) + code) * len(texts) + doc
        key, self.count = np.unique(key, return_counts=True)
        self.row, self.held = np.divmod(key, max(len(texts), 1))
        self.new = np.r_[True, self.row[1:] != self.row[:-1]][: len(key)]
        self.start = np.flatnonzero(self.new)
        self.n_docs = np.diff(np.r_[self.start, len(key)])

    def keys(self) -> list[pa.Array]:
        lang, chunk = np.divmod(self.row[self.start], max(1, len(self.names)))
        return [self.languages.dictionary.take(pa.array(lang)), self.names.take(pa.array(chunk))]

    def counted(self) -> pa.RecordBatch:
        """How many of the documents hold each chunk."""
        return pa.RecordBatch.from_arrays([*self.keys(), pa.array(self.n_docs.astype(np.int32))], ["lang", "chunk", "n_docs"])

    def told(self, source: pa.Array, batch: int, least_docs: int) -> pa.RecordBatch:
        """Which documents hold a chunk, if they are fewer than least_docs, and its uses by source."""
        sources = pc.dictionary_encode(source)
        n_sources = max(1, len(sources.dictionary))
        use, at = np.unique((np.cumsum(self.new) - 1) * n_sources + np.asarray(sources.indices, np.int64)[self.held], return_inverse=True)
        used_by, used = np.divmod(use, n_sources)
        first = pa.array(np.searchsorted(used_by, np.arange(len(self.start) + 1)), pa.int32())
        few = self.n_docs < least_docs
        docs = pa.array(np.cumsum(np.r_[0, np.where(few, self.n_docs, 0)]), pa.int32())
        columns = [
            pa.array(np.full(len(self.start), batch, np.int64)),
            *self.keys(),
            pa.ListArray.from_arrays(docs, pa.array(self.held[np.repeat(few, self.n_docs)].astype(np.int16))),
            pa.ListArray.from_arrays(first, sources.dictionary.take(pa.array(used))),
            pa.ListArray.from_arrays(first, pa.array(np.bincount(at, weights=self.count, minlength=len(use)).astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["batch", "lang", "chunk", "docs", "sources", "uses"])


def _factored(batches: Iterator[pa.RecordBatch], number: int, least_docs: int | None) -> Iterator[pa.RecordBatch]:
    """The chunks of batches(text, lang, source), slice by slice; number is that of the first slice."""
    for whole in batches:
        for top in range(0, whole.num_rows, SLICE_ROWS):
            part = whole.slice(top, SLICE_ROWS)
            for lo, hi in slices(flat(part.column(0))[1], SLICE_BYTES):
                texts, lang, source = (c.slice(lo, hi - lo) for c in part.columns)
                found = _Factored(texts, lang)
                out = found.counted() if least_docs is None else found.told(source, number, least_docs)
                number += 1
                del found
                for at in range(0, out.num_rows, 20_000):
                    yield out.slice(at, 20_000)
                # neither the next slice nor a worker that is used again holds this one
                del out
                pa.default_memory_pool().release_unused()


def chunks(docs: DataFrame, least_docs: int | None = None) -> DataFrame:
    """The chunks of docs(text, lang, source) batch by batch: (lang, chunk, n_docs), or (batch, lang, chunk, docs, sources, uses) if least_docs is given.

    docs are numbers of rows within the batch, told where they are fewer than least_docs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _factored(batches, TaskContext.get().partitionId() << 20, least_docs)

    return docs.select("text", "lang", "source").mapInArrow(run, _COUNTED if least_docs is None else _TOLD)


def term_counts(docs: DataFrame, *, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of terms in at least least_docs documents of their language: occurrences in each source that has any; stored.

    docs(text, lang, source) has no nulls. A term has at least as many documents
    as one of its chunks, and at most as many as all of them together; only where
    least_docs lies between, documents are told apart. Texts are read twice:
    uses by source are gathered for chunks of terms that may be kept.
    """
    known = chunks(docs).repartition("chunk").groupBy("chunk", "lang").agg(F.sum("n_docs").alias("docs"))
    spread = known.groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs"))
    # a term that a chunk has twice comes twice, and so do its uses below
    tokens = spread.select("chunk", "langs", F.explode(F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(f"({TERM})"))).alias("term"))
    terms = written(tokens.select("chunk", "term", F.inline("langs")))
    likely = terms.groupBy("lang", "term").agg(F.sum("docs").alias("most"), (F.max("docs") >= least_docs).alias("sure")).where(F.col("most") >= least_docs).drop("most")
    wanted = written(terms.drop("docs").join(_small(written(likely)), ["lang", "term"]))

    met = chunks(docs, least_docs)
    key = F.xxhash64("lang", "chunk")
    if wanted.count() <= BROADCAST_ROWS:
        # most chunks meet no term: they needn't travel
        met = met.join(F.broadcast(wanted.select(key.alias("_key")).distinct()), key == F.col("_key"), "left_semi")
    met = met.join(wanted, ["lang", "chunk"])
    uses = F.transform(F.arrays_zip("sources", "uses"), lambda u: F.struct(u["sources"].alias("source"), F.lit(None).cast("long").alias("doc"), u["uses"].cast("long").alias("n")))
    places = F.transform("docs", lambda d: F.struct(F.lit(None).cast("string").alias("source"), (F.col("batch") * SLICE_ROWS + d).alias("doc"), F.lit(0).cast("long").alias("n")))
    told = met.select("lang", "term", "sure", F.inline(F.when(F.col("sure"), uses).otherwise(F.concat(uses, places))))
    summed = written(told.groupBy("lang", "term", "sure", "source", "doc").agg(F.sum("n").alias("n")))
    unsure = summed.where("not sure and doc is not null").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    used = summed.where("doc is null").select("lang", "source", "term", "n", "sure")
    return cut(used.where("sure").drop("sure").unionByName(used.where("not sure").drop("sure").join(unsure, ["lang", "term"])))


def _small(rows: DataFrame) -> DataFrame:
    """Stored rows, marked for a broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS // 4 else rows


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly; null for no terms."""
    top, below = ((n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + SMOOTH * terms).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function("div", top, F.when(below > 0, below))


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """For each two sources of a block of terms, the sum of their differences less that of terms which neither has."""
    names = pc.dictionary_encode(rows.column("source").combine_chunks())
    source = np.asarray(names.indices, np.int64)
    marks = np.asarray(rows.column("mark"))
    p, side = (np.asarray(rows.column(c)) for c in ("p", "sb"))
    base, block = np.zeros(len(names.dictionary), np.int64), np.zeros(len(names.dictionary), np.int64)
    base[source[marks]], block[source[marks]] = p[marks], side[marks]
    term = pc.dictionary_encode(rows.column("term").combine_chunks().filter(pa.array(~marks)))
    matrix = np.repeat(base[:, None], len(term.dictionary), axis=1)
    matrix[source[~marks], np.asarray(term.indices, np.int64)] = p[~marks]
    lang, _, lo, hi = (x.as_py() for x in key)
    out = []
    for a in np.flatnonzero(block == lo).tolist():
        others = np.flatnonzero(block == hi)
        others = others[others > a] if lo == hi else others
        apart = np.abs(matrix[others] - matrix[a]) - np.abs(base[others] - base[a])[:, None]
        out += zip([a] * len(others), others.tolist(), apart.sum(axis=1, dtype=np.int64).tolist(), strict=True)
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    plain = names.dictionary.cast(pa.string())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": plain.take(pa.array(a, pa.int64())), "b": plain.take(pa.array(b, pa.int64())), "value": pa.array(value, pa.int64())})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways.

    Only terms that one of two sources has differ from the sources' shares of an
    absent term; blocks of terms and sources give sums of these, and the rest is
    the difference of absent terms, for all terms of the language.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).cast("int").alias("n_sb"), F.ceil(F.max("terms") / TERM_BLOCK).cast("int").alias("n_tb"))
    placed = groups.join(blocks, "lang").withColumn("sb", F.pmod(F.xxhash64("source"), F.col("n_sb")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("n_sb") - 1)).alias("other")
    key = ("lang", "tb", F.least("sb", "other").alias("lo"), F.greatest("sb", "other").alias("hi"), "source", "sb", "term", "p", "mark")
    marks = placed.where("terms > 0").select("lang", "source", "sb", "n_sb", F.explode(F.sequence(F.lit(0), F.col("n_tb") - 1)).alias("tb"), F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.lit(True).alias("mark"))
    cells = shares.select("lang", "source", "term", "p").join(placed.select("lang", "source", "sb", "n_sb", "n_tb"), ["lang", "source"])
    cells = cells.select("lang", "source", "sb", "n_sb", F.pmod(F.xxhash64("term"), F.col("n_tb")).cast("int").alias("tb"), "term", "p", F.lit(False).alias("mark"))
    dealt = marks.unionByName(cells).select("*", each).select(*key)
    parts = dealt.groupBy("lang", "tb", "lo", "hi").applyInArrow(_block, "lang string, a string, b string, value long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(summed.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    absent = groups.select("lang", "source", F.coalesce("base", F.lit(0)).alias("base"), "terms")
    every = absent.join(absent.select("lang", F.col("source").alias("item"), F.col("base").alias("other")), "lang").where("source <> item")
    rest = every.select("lang", "source", "item", (F.abs(F.col("base") - F.col("other")) * F.col("terms")).alias("value"))
    return both.unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of docs: the divergence from each other source of its language, and its foremost terms.

    A null text, lang or source counts as ''. Every row is a document, repeated
    ones too. A group without kept terms still has its pairs; with no kept term in
    its language their values are 0. An empty table gives no rows, and so does a
    language with one source and no term that this source uses more than the
    language does.
    """
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counts = term_counts(own, least_docs=least_docs)
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("all"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.groupBy("lang", "source").agg(F.lit(1).alias("_")).drop("_").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("terms", "all", "total")))
    groups = cut(groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms"))))
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "terms", "all", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    above = shares.join(of_lang, ["lang", "term"]).withColumn("value", F.col("p") - _share(F.col("n_lang"), F.col("all"), F.col("terms"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    pairs = _pairs(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(top).withColumn("rank", F.col("rank").cast("int"))


def oracle() -> str:
    """The audit of documents in DuckDB's SQL."""
    share = "(1 + ({s}::HUGEINT * ({n} + {a})) // ({total} + {a} * {v}))::BIGINT"
    p, q, b = (share.format(s=SCALE, a=SMOOTH, n=n, total=total, v="v") for n, total in (("n", "total"), ("n_lang", "total_lang"), ("coalesce(c.n, 0)", "g.total")))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '{TERM}')), '{UPPER}', '{LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total_lang, 0) AS total_lang, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs USING (lang) LEFT JOIN sums USING (lang, source)),
shares AS (SELECT g.lang, g.source, k.term, {b} AS p FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {p} - {q} AS value FROM counts JOIN groups USING (lang, source) JOIN kept USING (lang, term) WHERE {p} > {q})
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
