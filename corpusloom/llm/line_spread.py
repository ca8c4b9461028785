"""Cross-site boilerplate lines, found by how far each line spreads.

Per line hash HyperLogLog sketches of the sites that carry the line are merged by
aggregation; lines whose estimates lie near the threshold get exact distinct
counts instead. Copies of one document carry all their lines to many sites as
well, so the spread is taken twice: over all documents, which gives the
candidates, and again over those documents of which candidates are only a small
part (``most_share`` of their characters). What spreads there stands beside text
that is the documents' own, and is boilerplate; it goes from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, cut, joined_by_weight, plain_docs, unboxed

MIN_SITES, MOST_SHARE, BAND, LG_K = 5, 0.3, 0.3, 10
_LINE, _DOC = ["h1", "h2"], ["doc_id", "text_hash"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, doc_chars, pos, chars, h1, h2) for each line that isn't blank; doc_chars are those of its document."""
    parts = docs.select("doc_id", "site", F.xxhash64("text").alias("text_hash"), F.length("text").alias("doc_chars"), F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)).alias("parts"))
    rows = parts.select(*_DOC, "site", "doc_chars", F.posexplode("parts").alias("pos", "line")).where("line <> ''")
    return rows.select(*_DOC, "site", "doc_chars", "pos", F.length("line").alias("chars"), F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def spread_over_sites(lines: DataFrame, *, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(h1, h2, n): the lines of lines(h1, h2, site, ...) that min_sites sites or more carry, with their number of rows; stored."""
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")
    maybe = cut(lines.groupBy(*_LINE).agg(estimate, F.count(F.lit(1)).alias("n")).where(F.col("sites") >= min_sites * (1 - band)))
    clear = F.col("sites") > min_sites * (1 + band)
    near = maybe.where(~clear).select(*_LINE, "n")
    exact = joined_by_weight(lines.select(*_LINE, "site"), near, _LINE).select(*_LINE, "site").distinct().groupBy(*_LINE).agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites)
    return cut(maybe.where(clear).select(*_LINE, "n").unionByName(near.join(exact.select(*_LINE), _LINE, "left_semi")))


def boilerplate(docs: DataFrame, *, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", min_sites: int = MIN_SITES, band: float = BAND, most_share: float = MOST_SHARE) -> DataFrame:
    """(doc_id, text_hash, pos): the places of boilerplate lines in docs, once each."""
    lines = _lines(plain_docs(docs, id_col=id_col, text_col=text_col, keep=(F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),)))
    found = joined_by_weight(lines, spread_over_sites(lines, min_sites=min_sites, band=band), _LINE).drop("n").distinct()
    own = F.sum("chars").over(Window.partitionBy(*_DOC, "site"))
    found = cut(found.withColumn("beside", own <= most_share * F.col("doc_chars")))
    spread = spread_over_sites(found.where("beside"), min_sites=min_sites, band=band)
    return joined_by_weight(found, spread, _LINE).select(*_DOC, "pos").distinct()


def drop_boilerplate(docs: DataFrame, *, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", min_sites: int = MIN_SITES, band: float = BAND, most_share: float = MOST_SHARE, counts: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of text_col; if counts, with n_lines and n_removed (longs) added in place of columns of these names.

    Lines are compared without blanks at their ends; blank lines always stay. A
    null text gives an empty one, a null site is a site of its own, repeated rows
    are treated alike, and all other columns come back as they were, whatever
    their names. A document of nothing but boilerplate becomes empty; documents
    that are copies of each other keep the lines that only they share.
    """
    bad = boilerplate(docs, site_col=site_col, id_col=id_col, text_col=text_col, min_sites=min_sites, band=band, most_share=most_share)
    bad = bad.groupBy(*_DOC).agg(F.collect_list("pos").alias("gone"))
    own = boxed(docs, text=F.coalesce(F.col(text_col), F.lit("")), id=F.col(id_col).cast("long")).withColumn("hash", F.xxhash64("text"))
    joined = own.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    lines = joined.withColumn("lines", F.split("text", "\n", -1))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter("lines", lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    new: dict[str, Column] = {"n_lines": F.size("lines").cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")} if counts else {}
    return unboxed(lines, docs, {text_col: kept} | new)


def oracle(min_sites: int = MIN_SITES, most_share: float = MOST_SHARE) -> str:
    """The same over documents, in DuckDB's SQL, with exact counts throughout."""
    return f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, '')) AS doc_chars, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), placed AS (
  SELECT *, trim(raw, ' ') AS line FROM lines
), candidates AS (
  SELECT line FROM placed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}
), marked AS (
  SELECT p.*, c.line IS NOT NULL AS candidate FROM placed p LEFT JOIN candidates c USING (line)
), judged AS (
  SELECT *, sum(CASE WHEN candidate THEN length(line) ELSE 0 END) OVER (PARTITION BY doc_id) <= {most_share}::DOUBLE * doc_chars AS beside FROM marked
), spread AS (
  SELECT line FROM judged WHERE candidate AND beside GROUP BY line HAVING count(DISTINCT source) >= {min_sites}
), told AS (
  SELECT j.*, s.line IS NOT NULL AS gone FROM judged j LEFT JOIN spread s USING (line)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id"""
