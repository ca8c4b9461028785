"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is stored and
read again as the next one's docs. The near-duplicate classes, the secret links
and the packing aren't SQL, so there is no oracle; tests hold each stage against
a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import line_spread, packing, quality_knn, secret_links, simhash_golay
from corpusloom.llm.common import cut, table
from corpusloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_knn.accepted(docs, table(spark, sf_dir, "labels"))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread across sites."""
    return _counted(line_spread.drop_boilerplate(docs, counts=False), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash_golay.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets, and the parts linked to them, masked."""
    return _counted(secret_links.redact(docs), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a sequence."""
    # the workers' memory is also that of the other stages
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), most_words=100_000)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars as the text now has them."""
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", boilerplate),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is stored in the shared folder before the next reads it."""
    out = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = cut(stage(spark, out, sf_dir))
    return STAGES[-1][1](spark, out, sf_dir)
