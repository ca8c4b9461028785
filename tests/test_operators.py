"""Hand-made cases of the operators."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import scalars as S
from corpusloom.operators import catalog, chunk, corpus, evaluate, extract, graph, retrieve, tables
from corpusloom.sources import pages as P


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- corpus


def test_priority_dedup(spark):
    rows = [(0, "a", "What  is X?", "html_accordion"), (1, "b", "what is x?", "pdf"), (2, "c", "what is X?", "html_accordion"), (3, "d", "other", "html_accordion")]
    df = spark.createDataFrame(rows, "input_pos long, qa_id string, question string, source_type string")
    assert {r["qa_id"] for r in corpus.deduplicated(df).collect()} == {"b", "d"}
    assert {(r["dropped_qa_id"], r["kept_qa_id"]) for r in corpus.dedup_log(df).collect()} == {("a", "b"), ("c", "b")}


def test_landing_pages_go_to_the_log(spark):
    rows = [(i, f"q{i}", f"question {i}", "short" if i else "x" * 200, "html_accordion", "low" if i < 2 else "high", [], "/t", "u") for i in range(3)]
    parts = corpus.build_corpus(spark.createDataFrame(rows, "input_pos long, qa_id string, question string, answer string, source_type string, extraction_confidence string, cross_refs array<string>, topic_path string, source_url string"))
    assert {r["qa_id"] for r in parts["corpus"].collect()} == {"q0", "q2"}
    assert [r["qa_id"] for r in parts["filter_log"].collect()] == ["q1"]


# ---------------------------------------------------------------- scalars


@pytest.mark.parametrize(
    ("url", "kind", "topic", "short"),
    [
        ("https://x.org/en/a/b.pdf", "pdf", "/en/a/", "/a"),
        ("https://x.org/en/a/b.html?q=1#f", "html", "/en/a/", "/a"),
        ("https://x.org", "unknown", None, "/"),
        ("https://x.org/", "html", "/", "/"),
        ("https://x.org/a/b/c/d/e/f/", "html", "/a/b/c/d/e/f/", "/a/b/c/d/e"),
        ("https://x.org/a.zip", "unknown", "/", "/"),
    ],
)
def test_url_shapes(spark, url, kind, topic, short):
    u = F.lit(url)
    got = spark.range(1).select(S.source_type_of_url(u).alias("k"), S.topic_path(u).alias("t"), S.topic_path_short(u).alias("s")).first()
    assert (got["k"], got["t"], got["s"]) == (kind, topic, short)


@pytest.mark.parametrize(
    ("href", "expected"),
    [("/c", "https://x.org/c"), ("c.html", "https://x.org/a/c.html"), ("../c", "https://x.org/c"), ("//y.org/z#f", "https://y.org/z"), ("?q", "https://x.org/a/b?q"), ("#f", "https://x.org/a/b"), ("mailto:a@b", None), ("https://z.org/k", "https://z.org/k")],
)
def test_resolution(spark, href, expected):
    assert one(spark, S.resolved(F.col("h"), F.lit("https://x.org/a/b")), h=href) == expected


def test_header_metadata(spark):
    text = "# **Guide on things**\n\n12 March 2021\nEMA/CHMP/QWP/1234/2020 Rev. 2\n"
    got = one(spark, S.header_metadata(F.col("t")), t=text)
    assert (got["reference_number"], got["committee"], got["revision"], str(got["last_updated"])) == ("EMA/CHMP/QWP/1234/2020", "CHMP", "2", "2021-03-12")
    assert one(spark, S.markdown_title(F.col("t")), t=text) == "Guide on things"
    assert one(spark, S.header_metadata(F.col("t")), t="nothing 31 February 2021")["last_updated"] is None


def test_similarity_scale(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    got = spark.range(1).select(S.similarity(v(1, 0), v(1, 0)).alias("a"), S.similarity(v(1, 0), v(0, 1)).alias("b"), S.similarity(v(1, 0), v(-1, 0)).alias("c"), S.unit(v(3, 4)).alias("u"), S.unit(v(0, 0)).alias("z")).first()
    assert (got["a"], got["b"], got["c"]) == (1.0, 0.5, 0.0)
    assert got["u"] == [0.6, 0.8] and got["z"] == [0.0, 0.0]


def test_grades(spark):
    good = 'Sure:\n```json\n{"per_doc": [{"index": 0, "score": 2}], "missing_facts": []}\n```'
    got = spark.createDataFrame([(good,), ("no json",)], "t string").select(S.grade(F.col("t")).alias("g")).select(S.sufficient(F.col("g")).alias("s"), "g.parsed", S.grade_key(F.col("g")).alias("k")).collect()
    assert [(r["s"], r["parsed"], r["k"]["best"]) for r in got] == [(True, True, 2), (False, False, -1)]
    assert one(spark, S.judge_score(F.col("t")), t='x {"score": 4, "reason": "r"} y') == 4.0
    assert one(spark, S.judge_score(F.col("t")), t="x") == -1.0


def test_substance(spark):
    payload = json.dumps({"properties": {"PropertyTable": {"Properties": [{"Title": "Water", "MolecularWeight": "18.0"}]}}, "synonyms": {"InformationList": {"Information": [{"Synonym": ["H2O", "7732-18-5", "aqua"]}]}}})
    got = one(spark, S.substance(F.lit("water"), F.col("p")), p=payload)
    assert (got["name"], got["cas"], got["molecular_weight"], got["found"], list(got["synonyms"])) == ("Water", "7732-18-5", 18.0, True, ["H2O", "7732-18-5", "aqua"])
    assert one(spark, S.substance(F.lit("x"), F.col("p")), p="{}")["found"] is False


def test_marked_text(spark):
    spans = F.array(F.struct(F.lit(5).alias("end"), F.array(F.lit(2), F.lit(1)).alias("ns")), F.struct(F.lit(11).alias("end"), F.array(F.lit(3)).alias("ns")))
    assert one(spark, S.marked_text(F.col("t"), spans), t="hello world") == "hello [1][2] world [3]"


def test_ratings(spark):
    rows = [("true", "bool"), ("false", "bool"), ("0.5", "unit"), ("4", "stars"), ("x", "stars")]
    assert [r["x"] for r in spark.createDataFrame(rows, "v string, s string").select(S.rating(F.col("v"), F.col("s")).alias("x")).collect()] == [5.0, 1.0, 2.5, 4.0, None]


# ---------------------------------------------------------------- rules


def test_categories(spark):
    urls = {"https://x/en/documents/scientific-guideline/a": "scientific_guideline", "https://x/veterinary/guideline": "veterinary", "https://x/q-and-a": "qa", "https://x/zzz": "other", "": "other"}
    for url, expected in urls.items():
        assert one(spark, R.source_category(F.col("u")), u=url) == expected


def test_acronyms(spark):
    entries = [
        {"acronym": "AI", "canonical": "Acceptable Intake", "synonyms": ["safe intake"], "context_disambiguation": ["NOT artificial intelligence"], "topic_paths_where_relevant": ["nitrosamines"]},
        {"acronym": "TTC", "canonical": "Threshold of Concern"},
    ]
    say = lambda q: one(spark, R.acronym_expansion(F.col("q"), entries), q=q)
    assert say("What AI for nitrosamines?") == "What AI (Acceptable Intake) for nitrosamines?"
    assert say("Is AI smart?") == "Is AI smart?"
    assert say("threshold of concern limits") == "threshold of concern (TTC) limits"
    assert say("TTC and TTC") == "TTC (Threshold of Concern) and TTC"


def test_routing(spark):
    q = spark.createDataFrame([(1, "limits of Nitrosamine impurities"), (2, "a variation"), (3, "variations"), (4, "")], "query_id long, text string")
    got = {r["query_id"]: r["rule"] for r in retrieve.route(q).collect()}
    assert got == {1: "impurity_toxicology_limits", 2: "regulatory_procedures", 3: None, 4: None}


def test_unknown_category_is_an_error(spark):
    assert one(spark, retrieve.parse_categories(F.col("c")), c=" QA, epar,qa ") == ["qa", "epar"]
    with pytest.raises(Exception, match="unknown categories"):
        one(spark, retrieve.parse_categories(F.col("c")), c="qa, nonsense")


# ---------------------------------------------------------------- retrieval


def test_quota_and_order(spark):
    hits = spark.createDataFrame([(0, i, c, 1 - i / 10, i + 1) for i, c in enumerate("aaabb")], "query_id long, chunk_id long, category string, score double, rank int")
    assert [r["category"] for r in retrieve.quota(hits, {"b": 1}, 3).orderBy("rank").collect()] == ["a", "a", "b"]
    assert [r["category"] for r in retrieve.prefer(hits, ["b"]).orderBy("rank").collect()] == list("bbaaa")


def test_small_to_big(spark):
    hits = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 3, 0.7, 3)], "query_id long, chunk_id long, score double, rank int")
    parents = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "chunk_id long, parent_id long")
    assert [(r["returned_id"], r["matched_id"], r["score"]) for r in retrieve.small_to_big(hits, parents).orderBy("rank").collect()] == [(10, 1, 0.9), (3, 3, 0.7)]


def test_expansion_caps_before_leaving_out_what_was_returned(spark):
    hits = spark.createDataFrame([(0, 1, 1, 0.9, 1), (0, 5, 9, 0.8, 2)], "query_id long, chunk_id long, doc_id long, score double, rank int")
    links = spark.createDataFrame([(1, 2, "inline", "qa"), (1, 3, "other", "qa")], "src long, tgt long, link_context string, category string")
    scored = spark.createDataFrame([(0, 5, 2, 0.8), (0, 7, 3, 0.6)], "query_id long, chunk_id long, doc_id long, score double")
    among = lambda pairs: scored.join(pairs, ["query_id", "doc_id"], "left_semi")
    assert retrieve.expand_links(hits, links, among, max_expand=1).collect() == []
    assert [r["chunk_id"] for r in retrieve.expand_links(hits, links, among, max_expand=5).collect()] == [7]
    assert [r["chunk_id"] for r in retrieve.expand_links(hits, links, among, contexts=["inline"]).collect()] == []


def test_ancestors_nearest_first(spark):
    hits = spark.createDataFrame([(0, 1, 11, 1), (0, 2, 12, 2)], "query_id long, chunk_id long, doc_id long, rank int")
    lines = spark.createDataFrame([(11, [100, 12])], "doc_id long, ancestor_ids array<long>")
    scored = spark.createDataFrame([(0, 50, 100, 0.4), (0, 51, 12, 0.5)], "query_id long, chunk_id long, doc_id long, score double")
    among = lambda pairs: scored.join(pairs, ["query_id", "doc_id"], "left_semi")
    assert [r["doc_id"] for r in retrieve.expand_ancestors(hits, lines, among).collect()] == [100]


def test_filter_falls_back_per_query(spark):
    chunks = spark.createDataFrame([(i, None, i, "qa" if i < 3 else "news", [float(i == 0), float(i != 0)]) for i in range(6)], "chunk_id long, parent_id long, doc_id long, category string, vec array<double>")
    queries = spark.createDataFrame([(1, "plain", [1.0, 0.0], "epar"), (2, "plain", [1.0, 0.0], "qa"), (3, "a variation", [0.0, 1.0], "")], "query_id long, text string, vec array<double>, source_category string")
    got = retrieve.steered(queries, chunks, k=3).collect()
    by = lambda q: [r for r in got if r["query_id"] == q]
    assert {r["notes"] for r in by(1)} == {"filter was empty, unfiltered"} and len(by(1)) == 3
    assert {r["category"] for r in by(2)} == {"qa"}
    assert next(r for r in by(3) if r["rank"] == 1)["notes"] == "preferred"


# ---------------------------------------------------------------- catalog


def test_budget_and_picks(spark):
    chunks = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate((50, 30, 40))], "query_id long, rank long, text string")
    assert [r["rank"] for r in catalog.within_budget(chunks, 20).collect()] == [0, 1]
    assert [r["rank"] for r in catalog.within_budget(chunks, 5).collect()] == [0]
    picks = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", None), (2, "b", None)], "ask long, hub string, score double")
    assert {r["ask"]: r["hub"] for r in catalog.picked_hub(picks).collect()} == {1: "b", 2: "a"}


def test_hub_keys(spark):
    rows = spark.createDataFrame([("https://x/a/topic-one",), ("https://x/b/topic-one",), ("https://x/2020-list",)], "source_url string")
    known = spark.createDataFrame([("topic_one",)], "hub string")
    assert sorted(r["hub"] for r in catalog.hub_keys(rows, known).collect()) == ["h_2020_list", "topic_one_2", "topic_one_3"]


# ---------------------------------------------------------------- graph


def test_walk_stops_at_what_does_not_qualify(spark):
    docs = spark.createDataFrame([(i, "qa" if i in (4, 5) else "no", None, "vet" if i == 5 else None) for i in range(1, 7)], "doc_id long, category string, doc_type string, audience string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 5)], "src long, tgt long")
    hubs = spark.createDataFrame([("h", 1, 2, ["qa"], [], ["vet"])], "hub string, seed long, hops int, categories array<string>, doc_types array<string>, exclude_audience array<string>")
    assert {r["doc_id"] for r in graph.qualified_walk(hubs, docs, edges, most_hops=2).collect()} == {1, 4}


def test_site_tree(spark):
    docs = spark.createDataFrame([("d1", "html", "/m"), ("d2", "html", "/m/h/p"), ("d3", "pdf", "/x/y"), ("d4", "pdf", "/d/r")], "doc_id string, source_type string, topic_path string").withColumn("source_url", F.lit(""))
    got = {r["doc_id"]: r for r in graph.tree_records(docs, spark.createDataFrame([("d2", "d3")], "src string, tgt string")).collect()}
    assert [got[d]["depth"] for d in ("d1", "d2", "d3", "d4")] == [1, 3, 4, 3]
    assert list(got["d3"]["path"]) == ["m", "h", "p"] and list(got["d3"]["ancestor_ids"]) == ["d1", "d2"]
    assert got["d3"]["parent_id"] == "d2"


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), *((i, i + 1) for i in range(20, 40))], "src long, tgt long")
    got = {r["node"]: (r["component"], r["is_small"]) for r in graph.components(edges).collect()}
    assert got[3] == (1, False) and got[8] == (7, True) and got[40] == (20, False)


# ---------------------------------------------------------------- tables


def test_labels(spark):
    docs = spark.createDataFrame([("a", "html"), ("b", "html"), ("c", "pdf")], "url string, source_type string")
    meta = spark.createDataFrame([("a", None)], "url string, audience string")
    badges = spark.createDataFrame([(u, "Human") for u in "abc"], "url string, audience string")
    assert {r["url"]: r["audience"] for r in tables.label_documents(docs, meta, badges, ["audience"]).collect()} == {"a": None, "b": "Human", "c": None}


def test_membership_upsert(spark):
    old = spark.createDataFrame([("u", ["a", "c"]), ("v", ["a"])], "url string, topic_hubs array<string>")
    new = spark.createDataFrame([("u", ["b"]), ("w", ["a"])], "url string, topic_hubs array<string>")
    assert {r["url"]: list(r["topic_hubs"]) for r in tables.upsert_hubs(old, new, ["a", "b"]).collect()} == {"u": ["b", "c"], "v": [], "w": ["a"]}
    with pytest.raises(Exception, match="outside the build"):
        tables.upsert_hubs(old, new, ["b"]).collect()


def test_keyed_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "url string, v long")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("b", 3)], "url string, v long")
    assert {(r["url"], r["v"]) for r in tables.upsert(old, new, ["url"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert tables.upsert_counts(old, new, ["url"]).first().asDict() == {"matched": 1, "modified": 1, "upserted": 1}


# ---------------------------------------------------------------- extraction


MARKDOWN = "# Title **x**\n\nEMA/CHMP/12345/2020 Rev. 3\n\n## 1. What is it?\nAn **answer**. See Q&A 2 and question 9.\n\n\n\nMore\n## 2. Second one\nText (see EMA/ABC/99/2019) [a link](https://x.org/p#f)\n## References\n## 3. Not this\nno\n"


def test_markdown_questions(spark):
    docs = spark.createDataFrame([("https://x.org/en/a/b.pdf", MARKDOWN), ("https://x.org/empty", None)], "url string, markdown string")
    got = sorted(extract.markdown_qa(docs).collect(), key=lambda r: r["seq"])
    assert [(r["question"], r["answer"], r["extraction_confidence"]) for r in got] == [("What is it?", "An answer. See Q&A 2 and question 9.\n\nMore", "high"), ("Second one", "Text (see EMA/ABC/99/2019) [a link](https://x.org/p#f)", "medium")]
    assert got[0]["cross_refs"] == [got[1]["qa_id"]] and got[1]["cross_refs"] == []
    assert (got[0]["source_title"], got[0]["revision"], got[0]["topic_path"]) == ("Title x", "Rev.3", "/a")


def test_mentions(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    got = extract.all_links(docs).collect()
    assert {(r["tgt_url"], r["link_type"]) for r in got} == {("https://x.org/p", "hyperlink"), ("EMA/CHMP/12345/2020", "reference_number"), ("EMA/ABC/99/2019", "reference_number"), ("qa:2", "see_qa")}


HTML = """<html><body><nav><a href="/skip">s</a></nav><main class="main-content-wrapper"><span class="x-bg-category"><span class="label">Human</span></span>
<p>Text <a href="/in">inline</a> <a href="mailto:a@b">m</a> <a href="#f">f</a></p><div class="bcl-file" data-x-document-type="Leaflet"><span class="file-title">A file</span><a href="/f.pdf">get</a></div>
<div class="listing-item"><a href="/in">card</a></div><a href="https://other.org/o">o</a><a href="/self#x">self</a>
<div class="accordion-item"><h2 class="accordion-header"><button>Is it so?</button></h2><div class="accordion-body">Yes.</div></div></main></body></html>"""


def test_typed_links_and_badges(spark):
    pages = spark.createDataFrame([(1, "https://x.org/self", HTML), (2, "https://x.org/no", "<p><a href=/z>z</a></p>"), (3, "https://x.org/null", None)], "page_id long, url string, html string")
    found = extract.page_elements(pages).join(pages.select("page_id", "url"), "page_id")
    links = {r["tgt_url"]: (r["link_context"], r["kind"], r["document_type"], r["anchor"]) for r in extract.typed_links(found, domains=("x.org",)).collect()}
    assert links == {"https://x.org/in": ("card_or_listing", "page", None, "card"), "https://x.org/f.pdf": ("file_component", "file", "Leaflet", "A file"), "https://other.org/o": ("other", "external", None, "o")}
    first = found.where("page_id = 1").first()
    assert first["audience"] == "Human" and first["site_topic"] is None
    qa = extract.accordion_qa(found).collect()
    assert [(r["question"], r["answer"], r["extraction_confidence"]) for r in qa] == [("Is it so?", "Yes.", "high")]
    assert {r["page_id"]: r["error"] for r in extract.parsed_pages(found).collect()}[3] == "empty_input"


def test_result_lines(spark):
    steps = spark.createDataFrame([(1, "[routed]\n[1] source=https://x category=qa score=0.5\ntext\n[2] source=https://y")], "step_id long, output string")
    assert [(r["n"], r["category"], r["score"]) for r in extract.result_lines(steps).collect()] == [(1, "qa", 0.5), (2, None, None)]
    assert [r["note"] for r in extract.note_lines(steps).collect()] == ["[routed]"]


def test_flat_chunks_carry_headings(spark):
    text = "# One\n" + "word " * 30 + "\n## Two\n" + "more " * 100
    got = sorted(chunk.flat_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), size=64, overlap=8).collect(), key=lambda r: r["chunk_index"])
    assert [(r["chunk_index"], r["heading_path"], r["token_count"]) for r in got] == [(0, "One", 32), (1, "Two", 64), (2, "Two", 46)]


def test_nested_chunks_keep_parents(spark):
    got = chunk.nested_chunks(spark.createDataFrame([("u", "longword " * 100), ("v", " ")], "url string, text string"), sizes=(64, 16)).collect()
    ids = {r["chunk_id"] for r in got}
    assert len(got) == len(ids) and all(r["parent_id"] in ids for r in got if r["level"] == 1)


def test_inventory(spark):
    item = '<div class="accordion-item">x</div>'
    pages = spark.createDataFrame([(1, "https://x/en/scope/questions", item * 2 + "<p>Rev. March 2020</p><p>Rev. May 2021</p>"), (2, "https://x/en/scope/other", item), (3, "https://x/veterinary/questions", item), (4, "https://x/en/scope/many", item * 5)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["q_count"], r["last_updated"]) for r in extract.inventory(pages, in_scope=("/en/scope",)).collect()}
    assert got == {1: (2, "May 2021"), 4: (5, "")}


# ---------------------------------------------------------------- evaluation


def test_means_take_numbers_only(spark):
    assert evaluate.mean_scores(spark.createDataFrame([("j", "4"), ("j", "x"), ("j", "5")], "name string, value string")).first()["mean"] == 4.5


def test_score_floor_refuses_unjudged_rows(spark):
    with pytest.raises(Exception, match="without a score"):
        evaluate.score_floor(spark.createDataFrame([(1, None), (2, 3)], "id long, score long"), 2).collect()


def test_claims_and_citations(spark):
    cited = spark.createDataFrame([("r", 1, "c1", "u1"), ("r", 2, "c2", "u1")], "run_id string, place int, chunk_id string, source_url string")
    claims = spark.createDataFrame([("r", 0, "c2", "u1"), ("r", 1, "zz", "u1"), ("r", 2, "zz", "none")], "run_id string, claim_no int, chunk_id string, source_url string")
    assert {(r["claim_no"], r["place"]) for r in evaluate.claim_citations(claims, cited).collect()} == {(0, 2), (1, 1)}


def test_claim_spans(spark):
    answers = spark.createDataFrame([("r", "The limit is  18 ng per day. Other words follow here.")], "run_id string, answer string")
    claims = spark.createDataFrame([("r", 0, "the limit is 18 ng per day"), ("r", 1, "Other words follow hers"), ("r", 2, "nothing of this kind at all"), ("r", 3, "short")], "run_id string, claim_no int, claim string")
    got = {r["claim_no"]: (r["start"], r["stop"]) for r in evaluate.claim_spans(answers, claims).collect()}
    assert got[0] == (0, 27) and got[2] == (None, None) and got[3] == (None, None)
    assert got[1][0] is not None
    spans = spark.createDataFrame([("r", 0, 10, 1), ("r", 5, 8, 2), ("r", 0, 10, 3), ("r", 12, 15, 4)], "run_id string, start long, stop long, place int")
    assert sorted((r["start"], r["stop"], list(r["places"])) for r in evaluate.without_overlaps(spans).collect()) == [(0, 10, [1, 3]), (12, 15, [4])]


def test_spans_are_places_of_the_answer_as_it_is(spark):
    cases = [
        ("  The  limit\n\tis\u00a0\u300018 ng.  End of it", "the limit is 18 ng."),
        ("Straße und GROSSE Straßen enden hier", "STRASSEN enden"),
        ("Straße und GROSSE Straßen enden hier", "ße und gross"),
        ("word\x1fother\x85third fourth", "OTHER third"),
        ("\u2003leading only and so on  ", "leading only"),
    ]
    answers = spark.createDataFrame([(str(i), a) for i, (a, _) in enumerate(cases)], "run_id string, answer string")
    claims = spark.createDataFrame([(str(i), 0, c) for i, (_, c) in enumerate(cases)], "run_id string, claim_no int, claim string")
    got = {r["run_id"]: (r["start"], r["stop"]) for r in evaluate.exact_spans(answers, claims).collect()}
    for i, (answer, claim) in enumerate(cases):
        text, places = evaluate.fold_with_places(answer)
        wanted = evaluate.fold_with_places(claim)[0]
        at = text.find(wanted)
        assert at >= 0 and got[str(i)] == (places[at], places[at + len(wanted) - 1] + 1)
    assert cases[0][0][slice(*got["0"])] == "The  limit\n\tis\u00a0\u300018 ng."


def test_nearest_window_is_the_first_best_of_all(spark):
    from difflib import SequenceMatcher

    claim = "the maximum daily intake is 18 ng"
    for answer in ("x " * 30 + "the maximal daily intake was 18 ng and more " + "y " * 9, "the maximum dally intake is 18 ng, the maximum daily intakes is 18 ng", "nothing alike " * 9):
        starts = range(0, len(answer) - len(claim) + 1, max(1, len(claim) // 5))
        ratio = [SequenceMatcher(None, claim, answer[a : a + len(claim)]).ratio() for a in starts]
        best = max(range(len(ratio)), key=lambda i: ratio[i])
        want = (starts[best], starts[best] + len(claim)) if ratio[best] >= 0.85 else None
        assert evaluate.nearest_window(answer, claim) == want
    assert evaluate.nearest_window("the maximum daily intake is 18", claim) == (0, 30)


def test_overlaps_against_all_pairs(spark):
    import random

    r = random.Random(2)
    rows = [(str(i % 5), a := r.randrange(100), a + r.randrange(1, 15), i) for i in range(200)]
    got = evaluate.without_overlaps(spark.createDataFrame(rows, "run_id string, start long, stop long, place int")).collect()
    for run in "01234":
        kept = []
        for a, b in sorted({(a, b) for x, a, b, _ in rows if x == run}, key=lambda s: (s[0] - s[1], s[0])):
            if all(b <= c or a >= d for c, d in kept):
                kept.append((a, b))
        assert sorted((x["start"], x["stop"]) for x in got if x["run_id"] == run) == sorted(kept)


def test_white_space_as_in_unicode(spark):
    odd = "What\u00a0\u00a0is\u3000X\x1f?\u2003 "
    assert one(spark, S.normalised(F.col("t")), t=odd) == " ".join(odd.lower().split())
    assert one(spark, S.quote(F.col("t")), t=odd) == " ".join(odd.split())


def test_chunk_ids(spark):
    import hashlib

    assert one(spark, S.chunk_id(F.col("t"), F.lit(7)), t="doc") == hashlib.sha256(b"doc|7").hexdigest()[:32]


def test_best_chunks_of_documents(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieve, "CHUNK_BLOCK", 16)
    r = np.random.default_rng(6)
    vectors = r.integers(-2, 3, (90, 4)).astype(float)
    chunks = spark.createDataFrame([(i, i // 7, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, doc_id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 90, 20)], "query_id long, vec array<double>")
    for k in (3, None):
        got = sorted((x["query_id"], x["rank"], x["doc_id"], x["chunk_id"], x["score"]) for x in retrieve.best_chunks(queries, chunks, k).collect())
        want = []
        for q in range(0, 90, 20):
            score = np.round((1 + vectors @ vectors[q]) / 2, 6)
            docs = {d: min(((-score[i], i) for i in range(90) if i // 7 == d)) for d in range(13)}
            ranked = sorted(docs, key=lambda d: (docs[d][0], d))[:k]
            want += [(q, n + 1, d, docs[d][1], -docs[d][0]) for n, d in enumerate(ranked)]
        assert got == sorted(want)


def test_every_document_of_split_documents_and_repeated_queries(spark, monkeypatch):
    import numpy as np

    for name, n in (("CHUNK_BLOCK", 16), ("ASKED_ALL", 3), ("SCORES", 40), ("LARGE", 9)):
        monkeypatch.setattr(retrieve, name, n)
    r = np.random.default_rng(8)
    vectors = r.integers(-2, 3, (120, 4)).astype(float)
    doc = [None if i < 5 else 1 if i < 60 else i // 7 for i in range(120)]
    chunks = spark.createDataFrame([(i, doc[i], v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, doc_id long, vec array<double>").repartition(3)
    asked = [(q, vectors[q * 9 % 120] * (1 + n)) for n, q in enumerate([*range(11), 4, 4, 7])]
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked], "query_id long, vec array<double>")
    got = retrieve.best_chunks(queries, chunks)
    want = {}
    for q, v in asked:
        for i in range(120):
            want[q, doc[i]] = min(want.get((q, doc[i]), (9e9, 0)), (-float(np.round((1 + vectors[i] @ v) / 2, 6)), i))
    assert {(x["query_id"], x["doc_id"]): (-x["score"], x["chunk_id"]) for x in got.collect()} == want
    assert got.count() == len(want)


def test_every_document_is_scored_a_few_queries_at_a_time(spark):
    """No task gathers the pairs of a block, neither in one table of Python nor in a shuffle."""
    import pyarrow as pa

    vectors = spark.range(300).selectExpr("id AS chunk_id", "id DIV 3 AS doc_id", "array(id / 300D, 1D) AS vec")
    plan = retrieve.best_chunks(vectors.selectExpr("chunk_id AS query_id", "vec"), vectors).select("query_id", "doc_id", "score")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "Aggregate" not in plan
    n = 1 << 12
    rows = pa.table({"block": pa.array([0] * (n + 2000), pa.int32()), "part": pa.array([0] * (n + 2000), pa.int32()), "asks": [False] * n + [True] * 2000, "doc_id": pa.array([*range(n), *[None] * 2000], pa.int64()), "id": pa.array([*range(n), *range(2000)], pa.int64()), "vec": pa.array([[1.0, i] for i in range(n + 2000)], pa.list_(pa.float64()))})
    sizes = [b.num_rows for b in retrieve._best_in_blocks(iter(rows.to_batches(1000)), 6)]
    assert sum(sizes) == n * 2000 and max(sizes) <= retrieve.SCORES


def test_retriever_metadata(spark):
    spans = spark.createDataFrame([("t", "a", None, "TOOL", None, None, 1), ("t", "b", "a", "CHAIN", None, None, 2), ("t", "c", "b", "RETRIEVER", "u", "first", 3), ("t", "d", "b", "RETRIEVER", "u", "second", 4), ("t", "e", None, "RETRIEVER", "v", "outside", 5)], "trace_id string, span_id string, parent_id string, kind string, source_url string, meta string, start_ns long")
    assert [(r["tool_span"], r["source_url"], r["meta"]) for r in evaluate.retriever_metadata(spans).collect()] == [("a", "u", "first")]


def test_triples(spark):
    triples = spark.createDataFrame([("drug", "TREATS", "disease"), ("drug", "EATS", "disease")], "subject string, relation string, object string")
    allowed = spark.createDataFrame([("DRUG", "TREATS", "DISEASE")], "subject string, relation string, object string")
    assert evaluate.valid_triples(triples, allowed).count() == 1
    assert evaluate.valid_triples(triples, allowed, rejected=True).first()["relation"] == "EATS"


def test_reference_numbers(spark):
    cited = spark.createDataFrame([("r", p) for p in (1, 2, 3)], "run_id string, place int")
    spans = spark.createDataFrame([("r", 3, 5), ("r", 1, 9), ("r", 3, 20)], "run_id string, place int, start int")
    assert {r["place"]: r["n"] for r in evaluate.reference_numbers(spans, cited).collect()} == {3: 1, 1: 2, 2: 3}


def test_rated_runs(spark):
    runs = spark.createDataFrame([("a", "q"), ("b", "q")], "run_id string, question string")
    marks = spark.createDataFrame([("a", "user_rating", "true", "bool", 0), ("a", "step_quality", "good", "text", 1), ("b", "user_rating", "0.1", "unit", 0)], "run_id string, name string, value string, scale string, pos int")
    got = evaluate.rated_runs(marks, runs, 2.0).collect()
    assert [(r["run_id"], r["rating"], r["step_ratings"]) for r in got] == [("a", 5.0, [Row(pos=1, value="good")])]


# ---------------------------------------------------------------- sources


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([(["https://x"], ["<p>a</p>"], ["text/HTML"]), (["https://y"], [], ["text/html"]), (None, ["b"], None)], "url array<string>, html_raw array<string>, content_type array<string>")
    assert [(r["url"], r["content_type"]) for r in P.raw_pages(raw).collect()] == [("https://x", "text/html")]
    export = tmp_path / "export.json"
    export.write_text('[{"document_url": "u1", "type": "A"} {"document_url": "u2", "type": ""},, {"document_url": "u1", "type": "B"}')
    assert {r["url"]: r["type"] for r in P.document_types(spark, str(export)).collect()} == {"u1": "B", "u2": ""}
    P.write_corpus({"corpus": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/corpus")).count() == 3
    owl = tmp_path / "c.owl"
    owl.write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="http://n/x#MarketingStatus"/><owl:Class rdf:about="http://n/x#Abc"><rdfs:label>A label</rdfs:label></owl:Class></rdf:RDF>')
    assert [r["label"] for r in extract.concepts_from_rdf(spark, str(owl)).collect()] == ["marketing status", "a label"]


def test_streams(spark, tmp_path):
    from corpusloom.streaming import incremental as Z

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string").write.parquet(source)
    run = lambda: Z.resumable_build(spark, source, "doc_id long, text string", target, str(tmp_path / "state"), lambda b: b).awaitTermination()
    run()
    spark.createDataFrame([(i, f"t{i}") for i in range(3, 8)], "doc_id long, text string").write.mode("append").parquet(source)
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(target).collect()) == list(range(8))
    keyed = str(tmp_path / "keyed")
    Z.keyed_upserts(spark, source, "doc_id long, text string", keyed, str(tmp_path / "state2"), key=("doc_id",)).awaitTermination()
    assert spark.read.parquet(f"{keyed}/v=1").count() == 8


def test_retrieval_takes_any_number_of_queries(spark):
    from corpusloom.operators import retrieve

    unit = "array(cos(id * 0.37D), sin(id * 0.37D)) AS vec"
    queries = spark.range(20_500).selectExpr("id AS query_id", unit)
    chunks = spark.range(40).selectExpr("id AS chunk_id", unit)
    got = retrieve.vector_topk(queries, chunks, 2)
    assert got.count() == 2 * 20_500
    own = got.where("query_id < 40 AND rank = 1").collect()
    assert len(own) == 40 and all(r["query_id"] == r["chunk_id"] and r["score"] == 1 for r in own)


def test_sinks_and_projections(spark, tmp_path):
    from corpusloom.sources import pages

    rows = spark.createDataFrame([(1, "a\tb", None), (2, "x", "y")], "id int, sentence string, note string")
    pages.write_inventory(rows, str(tmp_path / "i"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "i"), header=True).collect())) == [("1", "a\tb", None), ("2", "x", "y")]
    pages.write_sentences(rows, str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "s"), header=True, sep="\t").collect())) == [("1", "a\tb", None), ("2", "x", "y")]
    edges = spark.createDataFrame([(1, 2), (2, 9), (2, 1)], "src int, tgt int")
    docs, kept = pages.projected(spark.createDataFrame([(1, "t", 0), (2, "u", 0)], "doc_id int, title string, rest int"), edges, ["title"])
    assert docs.columns == ["doc_id", "title"] and sorted(map(tuple, kept.select("src", "tgt").collect())) == [(1, 2), (2, 1)]


def test_sampled_edges_are_the_same_each_time(spark):
    from corpusloom.operators import graph

    edges = spark.range(200).selectExpr("id as src", "id * 7 % 200 as tgt")
    one_time, again = (graph.sampled_edges(edges.repartition(n), 20).collect() for n in (2, 5))
    assert one_time == again and len(set(one_time)) == 20
    assert graph.sampled_edges(edges, 20, seed=1).collect() != one_time


def test_processors_in_order(spark):
    out = retrieve.apply_processors(spark.range(10), [lambda df: df.where("id > 3"), lambda df: df.limit(0).unionByName(df.selectExpr("id + 1 as id"))])
    assert sorted(r["id"] for r in out.collect()) == [5, 6, 7, 8, 9, 10]


def test_passage_lines(spark):
    got = spark.range(1).select(S.numbered_line(F.lit(2), F.lit("u"), F.lit("qa"), F.lit(0.5), F.lit("text"))).first()[0]
    assert got == "[2] source=u category=qa score=0.500\ntext"


def test_blocks_that_cannot_win_are_skipped(spark, monkeypatch):
    """Clustered vectors: the same rows as by all products, while most pairs of queries and blocks are skipped; ties and short vectors too."""
    import numpy as np

    monkeypatch.setattr(retrieve, "CHUNK_BLOCK", 64)
    monkeypatch.setattr(retrieve, "LEAST_DEALT", 1000)
    r = np.random.default_rng(11)
    centres = r.normal(size=(40, 16))
    vectors = centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16)) * 0.05
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[::9] = np.round(vectors[::9], 1)
    rows = [(i, i // 3, v.tolist()) for i, v in enumerate(vectors)] + [(3000, 5000, [0.5]), (3001, 5001, None)]
    vectors = np.concatenate([vectors, np.eye(1, 16) * 0.5])
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, vec array<double>").repartition(3)
    queries = chunks.where("chunk_id % 25 = 0").selectExpr("chunk_id AS query_id", "vec")
    asked, met = [], retrieve._met
    monkeypatch.setattr(retrieve, "_met", lambda blocks, rows, *x: (asked.append((rows.count(), blocks.count())), met(blocks, rows, *x))[1])
    ids = list(range(0, 3001, 25))
    score = np.round((1 + vectors[ids] @ vectors.T) / 2, 6)
    got = sorted((x["query_id"], x["rank"], x["chunk_id"], x["score"]) for x in retrieve.vector_topk(queries, chunks, 7).collect())
    order = [np.lexsort((np.arange(3001), -s))[:7] for s in score]
    assert got == sorted((q, n + 1, int(c), float(s[c])) for q, s, o in zip(ids, score, order, strict=True) for n, c in enumerate(o))
    (first, n_blocks), (second, _) = asked
    skipped = 1 - (first + second) / (len(ids) * n_blocks)
    print("blocks", n_blocks, "share of pairs skipped", round(skipped, 3))
    assert first == len(ids) and n_blocks > 40 and skipped > 0.5
    docs = sorted((x["query_id"], x["rank"], x["doc_id"], x["chunk_id"]) for x in retrieve.best_chunks(queries, chunks, 4).collect())
    want = []
    for q, s in zip(ids, score, strict=True):
        best = {}
        for c in np.lexsort((np.arange(3001), -s)).tolist():
            best.setdefault(rows[c][1], c)
        ranked = sorted(best, key=lambda d: (-s[best[d]], d))[:4]
        want += [(q, n + 1, d, best[d]) for n, d in enumerate(ranked)]
    assert docs == sorted(want)
