"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage.

    The folder is the one named by ``spark.checkpoint.dir``. Without one a local
    session (unit tests, notebooks) gets a temporary folder of its own, any other
    a folder in its warehouse, which all executors share. The shuffles on the way
    are deleted with the stored table in place.
    """
    _shared_folder(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made and run here are deleted after each, not when the driver's garbage collector comes to it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, set where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="corpusloom-checkpoint-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table of Parquet files beside the checkpoints, in columns and compressed: for tables that are large beside their input."""
    spark = df.sparkSession
    folder = f"{_shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        df.select("*").write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def plain_docs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns an operator reads; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)


#: Keys with most rows that joined_by_weight broadcasts; each other key has at most a thousandth of all rows.
HEAVY = 1000


def joined_by_weight(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keys(*on, n, ...), one row per key, where a key can have any share of rows.

    n, a key's number of rows, picks the HEAVY heaviest keys: rows of these are
    found by a broadcast of that many keys and stay where they are; all others
    meet in a shuffle. rows is read twice, and keys, which must be stored, often.
    """
    heavy = keys.orderBy(F.desc("n"), *on).limit(HEAVY)
    among = F.broadcast(heavy.select(*on))
    return rows.join(F.broadcast(heavy), on).unionByName(rows.join(among, on, "left_anti").join(keys.join(among, on, "left_anti"), on))


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of docs as one column, box, with further columns beside it whose names can't meet docs' own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("box"), *(x.alias(name) for name, x in keys.items()))


def unboxed(rows: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs out of box, in their order; those that new names get its values, and others that it names come last."""
    new = new or {}
    own = [new.get(c, F.col("box").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*own, *(x.alias(c) for c, x in new.items() if c not in docs.columns))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column end to end, and the n+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) else column.cast(wide)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most_bytes: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most most_bytes each (one row at least)."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = hi
    return out


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, for code that makes Python objects of whole batches."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; after it the worker, which stays for other tasks, gives the memory back that it no longer uses."""

    @wraps(run)
    def then_freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        # glibc keeps what is freed, other C libraries have no such call
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return then_freed


class Remembered(dict):
    """What a task has computed per key, in two generations of at most most entries each.

    A key met again in the newer generation's time moves into it, so that common
    keys stay while rare ones go, and memory is bounded.
    """

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = self.copy()
            self.clear()
        self[key] = value
