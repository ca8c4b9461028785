"""A keyed table in buckets: each change writes new versions of the buckets it touches, and a manifest names the versions that count.

FOLDER/v=N/bucket=B holds the rows of bucket B as change N left them;
FOLDER/manifests/N.json names, after change N, the version of every bucket.
Readers take the last manifest, so a change shows wholly or not at all, and one
that was broken off or comes again changes nothing twice.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import last_rows
from ..sources.shared import stored

BUCKETS = 64


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict | None:
    """The manifest of a change, or the last one: {change, schema, buckets: {bucket: version}, counts}; None if there is none."""
    files, path = _path(spark, f"{folder}/manifests")
    if number is None:
        if not files.exists(path):
            return None
        found = [s.getPath().getName() for s in files.listStatus(path)]
        number = max((int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit()), default=None)
        if number is None:
            return None
    elif not files.exists(_path(spark, f"{folder}/manifests/{number}.json")[1]):
        return None
    return json.loads(spark.read.text(f"{folder}/manifests/{number}.json", wholetext=True).first()[0])


def _put(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Writes a manifest beside its place and moves it there, which happens wholly or not at all."""
    files, target = _path(spark, f"{folder}/manifests/{number}.json")
    _, draft = _path(spark, f"{folder}/manifests/.{number}.draft")
    out = files.create(draft, True)
    out.write(json.dumps(content).encode())
    out.close()
    if not files.rename(draft, target):
        raise RuntimeError(f"manifest {number} of {folder} is there already")


def read(spark: SparkSession, folder: str, state: dict | None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The rows of some buckets, or all, as a manifest says; None if it has none of them."""
    wanted = [] if state is None else [(v, b) for b, v in state["buckets"].items() if buckets is None or int(b) in buckets]
    if not wanted:
        return None
    return spark.read.schema(state["schema"]).parquet(*(f"{folder}/v={v}/bucket={b}" for v, b in sorted(wanted)))


def table(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows of a keyed table, None before its first change."""
    return read(spark, folder, manifest(spark, folder))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def put(rows: DataFrame, folder: str, key: Sequence[str], number: int, *, buckets: int = BUCKETS) -> dict:
    """Change number of a keyed table: rows in place of those with their keys; returns {matched, modified, upserted}.

    Of several rows with a key the greatest counts; nulls in keys are values like
    others. Only the buckets that rows fall into are read and written. A change
    that is in the manifests already is passed over and gives its counts.
    """
    spark = rows.sparkSession
    if (done := manifest(spark, folder, number)) is not None:
        return done["counts"]
    state = manifest(spark, folder)
    buckets = buckets if state is None else state["of"]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = stored(last_rows(rows, key).withColumn("bucket", bucket))
    # at most as many as there are buckets
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
    before = read(spark, folder, state, touched)
    rest = [c for c in rows.columns if c not in key]
    names = [f"_{c}" for c in key]
    if before is None:
        before = rows.limit(0)
    old = before.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)), F.struct(*(F.col(c) for c in rest)).alias("_old"))
    joined = fresh.join(old, _same(key, names), "left")
    changed = ~F.struct(*(F.col(c) for c in rest)).eqNullSafe(F.col("_old")) if rest else F.lit(False)
    counts = joined.agg(F.count("_old").alias("matched"), F.count_if(F.col("_old").isNotNull() & changed).alias("modified"), F.count_if(F.col("_old").isNull()).alias("upserted")).first().asDict()
    mine = fresh.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)))
    kept = before.join(mine, _same(key, names), "left_anti").withColumn("bucket", bucket)
    if touched:
        fresh.unionByName(kept.select(*fresh.columns)).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number}")
    named = ({} if state is None else state["buckets"]) | {str(b): number for b in touched}
    _put(spark, folder, number, {"change": number, "of": buckets, "schema": rows._jdf.schema().toDDL(), "buckets": named, "counts": counts})
    return counts
