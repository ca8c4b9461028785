"""Every registered query at the smallest scale against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 6))
    return str(x)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))])
def test_query_agrees_with_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    mine = sorted(tuple(_cell(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    theirs = sorted(tuple(_cell(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_member_scores_of_all_documents(spark, duck):
    """Each query has a score for each document, in the query as in its SQL."""
    n = duck.sql("SELECT count(*) FILTER (vec_id % 20 = 0) * count(DISTINCT vec_id // 8) FROM embeddings").fetchall()[0][0]
    assert entry.queries()["member_scores"](spark, FOLDER).count() == n
    assert len(duck.sql(entry.oracle_sql()["member_scores"]).fetchall()) == n


def test_claim_spans_against_all_windows(spark, duck):
    """Exact places by search in the folded answer, else the best of all windows; overlaps go by comparing all pairs."""
    from difflib import SequenceMatcher

    from corpusloom.operators.evaluate import fold_with_places

    runs = {}
    for run, turn, text in duck.sql("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn").fetchall():
        runs.setdefault(run, []).append((turn, text))
    want = []
    for run, turns in runs.items():
        answer, places = fold_with_places(turns[0][1])
        spans = {}
        for turn, text in turns:
            claim = fold_with_places(text.split(".")[0])[0]
            if len(claim) < 8:
                continue
            at, size = answer.find(claim), len(claim)
            if at < 0 and len(answer) <= size:
                at, size = (0, len(answer)) if answer and SequenceMatcher(None, claim, answer).ratio() >= 0.85 else (-1, 0)
            elif at < 0:
                matcher, best = SequenceMatcher(None, claim, ""), 0.0
                for a in range(0, len(answer) - size + 1, max(1, size // 5)):
                    matcher.set_seq2(answer[a : a + size])
                    if matcher.ratio() > best:
                        best, at = matcher.ratio(), a
                at = at if best >= 0.85 else -1
            if at >= 0:
                spans.setdefault((places[at], places[at + size - 1] + 1), []).append(turn)
        kept = []
        for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if all(b <= c or a >= d for c, d in kept):
                kept.append((a, b))
        want += [(run, a, b, ",".join(map(str, sorted(spans[a, b])))) for a, b in kept]
    got = entry.queries()["claim_spans"](spark, FOLDER).select("run_id", "start", "stop", "places").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def _rows(spark, folder, name, **tables):
    """What a query and its SQL make of small tables of the test's own."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(folder)), con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    key = lambda rows: sorted(tuple(map(_cell, r)) for r in rows)
    return key(got.select(*columns).collect()), key(want.project(", ".join(columns)).fetchall())


def test_acronyms_with_one_character_between_them(spark, tmp_path):
    texts = ["of of", "of of of", "a of of, of", "of", "xof of_ of\n", "of\nof\n", "ofof of\u00e9 \u00e9of of", "", None, "of  of", "of\r\nof", "OF of"]
    got, want = _rows(spark, tmp_path, "acronym_variants", benchmark=spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    assert got == want


def test_raw_html_of_pages_that_share_an_address(spark, tmp_path):
    rows = [(1, "u", "one"), (2, "u", "two"), (3, "u", None), (4, "u", "four"), (5, None, "five"), (6, "", ""), (None, "u", "none"), (7, "v", "b"), (7, "v", "a"), (7, "v", "a"), (9, "xu", "nine"), (-1, "u", "one")]
    got, want = _rows(spark, tmp_path, "raw_html_lookup", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got == want


def test_markdown_questions_of_repeated_documents(spark, tmp_path):
    texts = [(0, "a b"), (1, "It's 1, or 2"), (1, "It's 1, or 2"), (2, ""), (3, "\u00e9\u00e9 " + "x" * 40), (3, "\u00e9\u00e9 " + "x" * 40), (3, "\u00e9\u00e9 " + "x" * 40), (7, "1" * 90000 + "of \n" * 9), (11, "  " * 20 + "late"), (None, "no")]
    got, want = _rows(spark, tmp_path, "markdown_questions", documents=spark.createDataFrame(texts, "doc_id long, text string"))
    assert got == want


def test_markdown_questions_read_each_text_once(spark):
    plan = entry.queries()["markdown_questions"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
