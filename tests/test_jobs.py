"""Composite jobs on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import jobs


def test_tables_of_a_graph(spark):
    parsed = spark.createDataFrame([("https://x/a", "text/html", "# A\n" + "word " * 60), ("https://x/b.pdf", "application/pdf", "other " * 60), ("https://x/c", "text/html", "")], "url string, content_type string, text string")
    links = spark.createDataFrame([("https://x/a", "https://x/b.pdf", "b"), ("https://x/a", "https://y/z", "z")], "src_url string, tgt_url string, anchor string")
    meta = spark.createDataFrame([("https://x/b.pdf", "Human", None)], "url string, audience string, site_topic string")
    badges = spark.createDataFrame([("https://x/a", "Vet", "T")], "url string, audience string, site_topic string")
    out = jobs.build_tables(parsed, links, meta, badges, sizes=(64, 16))
    assert {(r["url"], r["audience"], r["title"]) for r in out["documents"].collect()} == {("https://x/a", "Vet", "A"), ("https://x/b.pdf", "Human", "b.pdf")}
    assert out["links"].count() == 1
    chunks = out["chunks"].collect()
    assert {r["level"] for r in chunks} == {0, 1}
    again = jobs.build_tables(parsed, links, meta, badges, chunked=out["chunks"].select("doc_id"), sizes=(64, 16))
    assert again["chunks"].count() == 0


def test_memberships(spark):
    docs = spark.createDataFrame([(1, "x", None, None), (2, "qa", None, None), (3, "no", None, None)], "doc_id long, category string, doc_type string, audience string")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, tgt long")
    hubs = spark.createDataFrame([("h", 1, 2, ["qa"], [], [])], "hub string, seed long, hops int, categories array<string>, doc_types array<string>, exclude_audience array<string>")
    meta = spark.createDataFrame([(2, ["old", "h"]), (3, ["h"])], "doc_id long, topic_hubs array<string>")
    stamped, out = jobs.build_memberships(hubs, docs, edges, meta, ["h"])
    assert {r["doc_id"]: list(r["topic_hubs"]) for r in out.collect()} == {1: ["h"], 2: ["h", "old"], 3: []}
    with pytest.raises(ValueError, match="no documents"):
        jobs.build_memberships(hubs.withColumn("seed", F.lit(9).cast("long")), docs, edges, meta, ["h"])


def test_labels(spark):
    meta = spark.createDataFrame([("a", "Human", "T", "x"), ("b", "Vet", None, None)], "url string, audience string, site_topic string, doc_type string")
    badges = spark.createDataFrame([("a", None, "U")], "url string, audience string, site_topic string")
    types = spark.createDataFrame([("b", "Leaflet"), ("c", "")], "url string, type string")
    out, counts = jobs.enrich_labels(meta, badges, types, stamp=F.lit("now"))
    assert {r["url"]: (r["audience"], r["site_topic"], r["doc_type"]) for r in out.collect()} == {"a": (None, "U", "x"), "b": ("Vet", None, "Leaflet"), "c": (None, None, None)}
    assert {r["value"]: r["n"] for r in counts.collect()} == {"x": 1, "Leaflet": 1, "(none)": 1}
