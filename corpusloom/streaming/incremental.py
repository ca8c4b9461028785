"""Incremental builds over file streams, with the stream's checkpoint for resume and its state for what was seen."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import shared_folder
from . import keyed


def first_of_each(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key of a stream, null keys included: rows of later batches with a key that was seen go.

    The stream's state holds a mark for each key, so nothing that was written is
    read again. Of several new rows of one batch the one with the least JSON stays.
    """
    def one(_: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        state.update((True,))
        least = reduce(lambda a, b: a if a["_order"].iloc[0] <= b["_order"].iloc[0] else b, (p.sort_values("_order", kind="stable").head(1) for p in parts if len(p)))
        yield least.drop(columns=["_order", "_key"])

    rows = stream.withColumn("_key", F.col(key).cast("string")).withColumn("_order", F.to_json(F.struct(*stream.columns)))
    return rows.groupBy("_key").applyInPandasWithState(one, stream.schema, "seen boolean", "append", "NoTimeout")


def resumable_build(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], *, key: str = "doc_id", files_per_batch: int = 8) -> StreamingQuery:
    """Build over the new files of a folder, a micro-batch to target/batch=N; source rows whose key came before are passed over.

    A crash loses one micro-batch at most: it runs again and writes its folder
    anew. Keys are known by the state in checkpoint, so a target that another
    checkpoint made is an error.
    """
    if _exists(spark, target) and not _exists(spark, checkpoint):
        raise ValueError(f"{target} was not built with the checkpoint {checkpoint}")

    def each(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = _load(_files(spark, source, schema).option("maxFilesPerTrigger", files_per_batch), source, spark)
    return first_of_each(stream, key).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, source: str, schema):
    return spark.readStream.format("parquet").schema(schema)


def files(spark: SparkSession, source: str, schema) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    return _load(_files(spark, source, schema), source, spark)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _load(reader, source: str, spark: SparkSession) -> DataFrame:
    """A folder of files, or one file as the only one of its folder that counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).load(path.getParent().toString())
    return reader.load(source)


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def keyed_upserts(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, key: Sequence[str] = ("url", "parser", "parser_version"), *, files_per_batch: int = 1000) -> StreamingQuery:
    """Rows of new files put into a keyed table (keyed.table), a change for each micro-batch; late or repeated rows change nothing twice."""

    def each(batch: DataFrame, number: int) -> None:
        keyed.put(batch, folder, key, number + 1)

    stream = _load(_files(spark, source, schema).option("maxFilesPerTrigger", files_per_batch), source, spark)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rated_runs(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """Z3: (run_id, entry, rating): each run's first entry(run_id, ts, ...) and last rating(run_id, ts, rating), over tables or streams.

    Over streams it is a state of one row for each run, whenever its entry and its
    ratings come: use update mode. Of ratings of one moment the greatest counts, of
    entries of one moment the least by its other columns.
    """
    rest = [c for c in entries.columns if c not in ("run_id", "ts")]
    none = F.lit(None)
    entry = F.struct("ts", *rest)
    first = entries.select("run_id", entry.alias("entry"), none.cast("struct<ts:timestamp,rating:double>").alias("last"))
    kind = first.schema["entry"].dataType
    last = ratings.select("run_id", none.cast(kind).alias("entry"), F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("rating").cast("double").alias("rating")).alias("last"))
    return first.unionByName(last).groupBy("run_id").agg(F.min("entry").alias("entry"), F.max("last").alias("last")).select("run_id", "entry", F.col("last.rating").alias("rating"))


def rated_log(spark: SparkSession, entries: DataFrame, ratings: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Z3: the streams of entries and ratings as a keyed table (keyed.table) of runs; a late rating changes its run's row."""

    def each(batch: DataFrame, number: int) -> None:
        keyed.put(batch.where("entry is not null").select("run_id", "entry.*", "rating"), folder, ["run_id"], number + 1)

    return rated_runs(entries, ratings).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_ratings(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """Z3: the interaction log with each run's last rating; entries and ratings are append-only."""
    last = ratings.groupBy("run_id").agg(F.max_by("rating", F.struct("ts", "rating")).alias("_r"))
    first = entries.groupBy("run_id").agg(F.min_by(F.struct(*(c for c in entries.columns if c != "run_id")), "ts").alias("e")).select("run_id", "e.*")
    return first.join(last, "run_id", "left").withColumn("rating", F.coalesce("_r", "rating") if "rating" in entries.columns else F.col("_r")).drop("_r")


def rating_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Running means of a rating stream(ts, event_type, value) per type, for a streaming sink in update mode."""
    return events.withWatermark("ts", delay).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
