"""The registry of queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Unicode's white space and the four separators beside it, for DuckDB's regular expressions.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_NARROW = {"int", "smallint", "tinyint"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """df with whole numbers as longs, as SQL engines count."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in _NARROW else F.col(c) for c, t in df.dtypes))


def register(sql: str | None):
    """Registers a query under its function's name, with the same in DuckDB's SQL where that can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: wide(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put
