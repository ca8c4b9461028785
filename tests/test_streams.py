"""Keyed tables and streams after replays and crashes."""

import pytest

from corpusloom.streaming import incremental, keyed

SCHEMA = "doc_id long, part string, text string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_keyed_table_after_replay_and_crash(spark, tmp_path, monkeypatch):
    folder, key = str(tmp_path / "t"), ["doc_id", "part"]
    put = lambda rows, n: keyed.put(spark.createDataFrame(rows, SCHEMA), folder, key, n, buckets=4)
    assert keyed.table(spark, folder) is None
    first = [(1, "a", "x"), (1, "a", "y"), (None, "a", "n"), (2, None, "m"), (3, "c", None)]
    assert put(first, 1) == {"matched": 0, "modified": 0, "upserted": 4}
    assert put(first, 1) == {"matched": 0, "modified": 0, "upserted": 4}
    one = [(1, "a", "y"), (None, "a", "n"), (2, None, "m"), (3, "c", None)]
    assert _rows(keyed.table(spark, folder)) == sorted(one, key=str)
    # a change that is broken off before its manifest shows nothing, and comes again whole
    second = [(1, "a", "z"), (None, "a", "n"), (9, "q", "new")]
    with monkeypatch.context() as m:
        m.setattr(keyed, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            put(second, 2)
    assert _rows(keyed.table(spark, folder)) == sorted(one, key=str)
    assert put(second, 2) == {"matched": 2, "modified": 1, "upserted": 1}
    two = [(1, "a", "z"), (None, "a", "n"), (2, None, "m"), (3, "c", None), (9, "q", "new")]
    assert _rows(keyed.table(spark, folder)) == sorted(two, key=str)
    # an older change that comes late again changes nothing
    put(first, 1)
    assert _rows(keyed.table(spark, folder)) == sorted(two, key=str)
    touched = {b for b, v in keyed.manifest(spark, folder)["buckets"].items() if v == 2}
    assert 0 < len(touched) <= 3
    put([], 3)
    assert _rows(keyed.table(spark, folder)) == sorted(two, key=str)


def test_builds_take_each_key_once(spark, tmp_path):
    """Also null keys, rows that come again, and rows of one batch with one key; the batch that a crash lost runs again."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: incremental.resumable_build(spark, source, SCHEMA, target, state, lambda b: b.drop("part"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put([(1, "a", "one"), (1, "a", "another"), (None, "a", "none")])
    run().awaitTermination()
    put([(None, "b", "late"), (1, "b", "late"), (2, "b", "two")])

    def broken(_):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        incremental.resumable_build(spark, source, SCHEMA, target, state, broken).awaitTermination()
    run().awaitTermination()
    run().awaitTermination()
    assert _rows(spark.read.parquet(target).select("doc_id", "text")) == [(1, "another"), (2, "two"), (None, "none")]
    with pytest.raises(ValueError, match="was not built"):
        incremental.resumable_build(spark, source, SCHEMA, target, str(tmp_path / "other"), lambda b: b)


def test_late_ratings(spark, tmp_path):
    folders = {n: str(tmp_path / n) for n in ("entries", "ratings", "out", "state")}
    kinds = {"entries": "run_id long, ts timestamp, question string", "ratings": "run_id long, ts timestamp, rating double"}
    put = lambda n, rows: spark.createDataFrame(rows, kinds[n]).selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in kinds[n].split(", "))).write.mode("append").parquet(folders[n])
    stream = lambda n: incremental.files(spark, folders[n], kinds[n])
    run = lambda: incremental.rated_log(spark, stream("entries"), stream("ratings"), folders["out"], folders["state"]).awaitTermination()
    at = lambda m: __import__("datetime").datetime(2024, 1, 1, 0, m)
    put("entries", [(1, at(1), "q1"), (2, at(2), "q2")])
    put("ratings", [(1, at(3), 2.0), (7, at(1), 4.0)])
    run()
    got = lambda: {r["run_id"]: (r["question"], r["rating"]) for r in keyed.table(spark, folders["out"]).collect()}
    assert got() == {1: ("q1", 2.0), 2: ("q2", None)}
    # a later rating wins, an earlier one doesn't; of one moment the greatest; an entry after its rating finds it
    put("ratings", [(1, at(2), 5.0), (2, at(9), 1.0), (2, at(9), 3.0)])
    put("entries", [(7, at(5), "q7"), (1, at(8), "again")])
    run()
    assert got() == {1: ("q1", 2.0), 2: ("q2", 3.0), 7: ("q7", 4.0)}
