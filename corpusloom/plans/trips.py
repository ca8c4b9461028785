"""Registered queries that write a table in a source's form and read it back, and over texts of Markdown, traces and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, evaluate, extract
from ..sources import pages as P
from ..streaming.incremental import scratch
from .shared import read, register


def _joined(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---------------------------------------------------------------- sources and sinks


@register("SELECT 'p' || doc_id AS url, CASE WHEN doc_id % 4 = 1 THEN 'second' ELSE lang END AS type FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 4 = 1")
def export_types(spark, d):
    """An export of broken JSON, several records to a line and lines cut within records, some without an address, some twice."""
    n = F.col("doc_id")
    record = _joined('{"document_url": "', F.when(n % 5 != 0, _joined("p", n)).otherwise(""), '",\n "type" : "', F.col("lang"), '", "other": [1, }} ,, ')
    again = F.when(n % 4 == 1, _joined('{"type": "second",\n\n"document_url":"p', n, '"};')).otherwise("")
    folder = scratch(spark)
    read(spark, d, "documents").select(F.concat(record, again).alias("value")).write.text(folder)
    return P.document_types(spark, folder).where("url <> 'p'")


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'text/html' END AS content_type, sha256(text) AS text_sha FROM documents WHERE text <> '' AND doc_id % 7 <> 0")
def raw_page_scan(spark, d):
    """Raw pages whose fields are one-element lists; some have no address."""
    n = F.col("doc_id")
    raw = read(spark, d, "documents").select(F.array(F.when(n % 7 != 0, _joined("u", n)).otherwise("")).alias("url"), F.array("text").alias("html_raw"), F.array(F.when(n % 3 == 0, "Text/HTML")).alias("content_type"))
    return P.raw_pages(raw).select(F.substring("url", F.lit(2), F.lit(20)).cast("long").alias("doc_id"), "content_type", F.sha2("html", 256).alias("text_sha"))


@register("SELECT doc_id, lang, sha256(text) AS text_sha, n_chars FROM documents")
def corpus_lines(spark, d):
    """A corpus as JSON lines, read back."""
    folder = scratch(spark)
    docs = read(spark, d, "documents").select("doc_id", "lang", "text", "n_chars")
    P.write_corpus({"corpus": docs}, folder)
    return spark.read.schema(docs.schema).json(f"{folder}/corpus").select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"), "n_chars")


@register("SELECT page_id, url, length(html) AS size FROM pages")
def inventory_file(spark, d):
    """An inventory as CSV, read back."""
    folder = scratch(spark)
    rows = read(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("size"))
    P.write_inventory(rows, folder)
    return spark.read.schema(rows.schema).csv(folder, header=True)


@register("SELECT conv_id, turn, role, regexp_replace(text, '\\s+', ' ', 'g')[1:200] AS sentence FROM conversations")
def sentence_file(spark, d):
    """Sentences as tab-separated values, read back."""
    folder = scratch(spark)
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 200).alias("sentence"))
    P.write_sentences(rows, folder)
    return spark.read.schema(rows.schema).csv(folder, header=True, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@register("SELECT p_brand AS category, count(*) AS docs, coalesce(sum(n), 0)::BIGINT AS edges FROM part LEFT JOIN (SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part) GROUP BY ALL) ON id = p_partkey GROUP BY ALL")
def projected_graph(spark, d):
    """A column of the documents and the edges among them."""
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("category"), "p_name")
    edges = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt"))
    nodes, inside = P.projected(docs, edges, ["category"])
    counted = inside.groupBy(F.col("src").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(counted, "doc_id", "left").groupBy("category").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


@register("""WITH c AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(trim(p_type, ' ')) || ' & ' || p_size ELSE 'case of size' || p_partkey % 300 END AS label FROM part WHERE p_partkey % 3 > 0) SELECT DISTINCT label FROM c WHERE length(label) >= 4 AND label <> 'case of size7' ORDER BY length(label) DESC, label LIMIT 200""")
def concept_labels(spark, d):
    """Concepts of an RDF/XML file: labels, or names in camel case; some are of another namespace, some stand in others."""
    n, size = F.col("p_partkey"), F.col("p_size")
    about = F.when(n % 3 == 0, "http://other.org/").otherwise("http://x.org/o#")
    named = _joined('<owl:Class rdf:about="', about, "CaseOfSize", n % 300, '"/>')
    told = _joined('<owl:Class\n rdf:about="', about, "N", n, '">\n<rdfs:label xml:lang="en"> ', F.col("p_type"), " &amp; ", size, " </rdfs:label><owl:equivalentClass><owl:Class><owl:unionOf/></owl:Class></owl:equivalentClass>\n</owl:Class>")
    folder = scratch(spark)
    read(spark, d, "part").select(F.when(n % 2 == 0, told).otherwise(named).alias("value")).write.text(folder)
    return extract.concepts_from_rdf(spark, folder, namespaces=("http://x.org/",), stop=("case of size7",), limit=200)


# ---------------------------------------------------------------- Markdown questions

WORD = "regexp_replace(text, '[^A-Za-z ]', '', 'g')[1:30]"


@register(f"""WITH d AS (SELECT doc_id, trim({WORD}, ' ') AS w, doc_id % 4 + 2 AS n FROM documents), q AS (SELECT doc_id, w, n, unnest(range(n)) AS pos FROM d), r AS (SELECT *, CASE WHEN pos = n - 1 THEN 1 ELSE pos + 1 END AS seq, 'What ' || w || ' ' || pos || CASE WHEN pos % 2 = 0 THEN '?' ELSE '' END AS question, 'Answer ' || w || ' see Q&A ' || (pos + 2) || ' and see question 1 or see Q 99.' AS answer FROM q),
k AS (SELECT doc_id, seq, arg_max(question, pos) AS target FROM r GROUP BY ALL) SELECT r.doc_id, pos, r.seq, question, CASE WHEN pos % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, (SELECT target FROM k WHERE k.doc_id = r.doc_id AND k.seq = pos + 2) AS next_question, (SELECT target FROM k WHERE k.doc_id = r.doc_id AND k.seq = 1) AS first_question FROM r""")
def markdown_questions(spark, d):
    """Numbered questions of Markdown texts; of two with one number the last is meant, unknown numbers mean none."""
    n = F.col("doc_id")
    # the first 30 letters and spaces; a text is matched no further than they reach
    first = F.regexp_extract("text", r"\A(?:[^A-Za-z ]*+[A-Za-z ]){0,30}+", 0)
    word = F.trim(F.regexp_replace(first, "[^A-Za-z ]", ""))
    count = (n % 4 + 2).cast("int")

    def part(i):
        seq = F.when(i == count - 1, F.lit(1)).otherwise(i + 1)
        return _joined("## ", seq, ". What ", F.col("w"), " ", i, F.when(i % 2 == 0, "?").otherwise(""), "\n\n**Answer** ", F.col("w"), " see Q&A ", i + 2, " and see question 1 or see Q 99.\n\n")

    docs = read(spark, d, "documents").select("doc_id", word.alias("w"), count.alias("n"))
    text = _joined("# Title\n\n", F.array_join(F.transform(F.sequence(F.lit(0), count - 1), part), ""), "## Annex\n## 7. Not this?\nno\n")
    records = extract.markdown_qa(docs.select(_joined("u", n).alias("url"), text.alias("markdown")))
    # the next one comes before the first, where there is a next one
    size, asked = F.size("cross_refs"), F.col("cross_questions")
    return records.select(F.substring("source_url", F.lit(2), F.lit(20)).cast("long").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "seq", "question", F.col("extraction_confidence").alias("confidence"), F.when(size == 2, F.get(asked, F.lit(0))).alias("next_question"), F.get(asked, size - 1).alias("first_question"))


# ---------------------------------------------------------------- traces and answers


@register("""WITH s AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, turn, 1 AS n, 'u' || n AS source_url, CASE WHEN turn % 2 = 0 THEN role END AS category, CASE WHEN turn % 3 <> 0 THEN n / 8 END::DOUBLE AS score FROM s UNION ALL SELECT conv_id, turn, 2, 'v' || turn, role, NULL FROM s WHERE turn % 2 = 1""")
def tool_output_rows(spark, d):
    """Rows read back from stored tool output, between other lines."""
    turn, size = F.col("turn"), F.length("text")
    line = _joined("[1] source=u", size, F.when(turn % 2 == 0, _joined(" category=", F.col("role"))).otherwise(""), F.when(turn % 3 != 0, _joined(" score=", size / 8)).otherwise(" score=none"), "\nsome text [1] source=no\n", F.when(turn % 2 == 1, _joined("  [2] source=v", turn, " category=", F.col("role"), "\n")).otherwise("[note]\n"))
    steps = read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("step_id"), line.alias("output"))
    return extract.result_lines(steps).select("step_id.conv_id", "step_id.turn", "n", "source_url", "category", "score")


@register("""WITH a AS (SELECT conv_id AS run_id, count(*) FILTER (WHERE turn % 2 = 1) AS steps, arg_min(length(text) % 6, turn) AS stars FROM conversations GROUP BY conv_id) SELECT run_id, stars::DOUBLE AS rating, steps AS step_ratings FROM a WHERE stars >= 3""")
def rated_exports(spark, d):
    """Runs that a user rated with three stars or more, with their step ratings."""
    rows = read(spark, d, "conversations")
    score = (F.length("text") % 6).cast("string")
    stars = rows.select(F.col("conv_id").alias("run_id"), F.lit("user_rating").alias("name"), score.alias("value"), F.lit("stars").alias("scale"), F.col("turn").alias("pos"))
    steps = rows.where("turn % 2 = 1").select(F.col("conv_id").alias("run_id"), F.lit("step_quality").alias("name"), F.lit("1").alias("value"), F.lit("stars").alias("scale"), F.col("turn").alias("pos"))
    out = evaluate.rated_runs(stars.unionByName(steps), rows.select(F.col("conv_id").alias("run_id")).distinct(), least=3.0)
    return out.select("run_id", "rating", F.size("step_ratings").cast("long").alias("step_ratings"))


@register("SELECT conv_id, turn, CASE WHEN length(text) < 30 THEN text ELSE text[1:10] || CASE WHEN regexp_matches(text[10:10], '\\s') THEN '' ELSE ' ' END || '[1][3]' || text[11:20] || CASE WHEN regexp_matches(text[20:20], '\\s') THEN '' ELSE ' ' END || '[2]' || text[21:] END AS marked FROM conversations")
def marked_answers(spark, d):
    """Markers of sources put into answers."""
    span = lambda a, b, *ns: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.array(*map(F.lit, ns)).alias("ns"))
    spans = F.array(span(0, 10, 3, 1, 1), span(10, 20, 2))
    return read(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") < 30, F.col("text")).otherwise(S.marked_text(F.col("text"), spans)).alias("marked"))


@register("WITH c AS (SELECT p_partkey AS id, 'http://p.org/x/' || p_partkey % 40 || ' Topic/' AS url, p_partkey FROM part), k AS (SELECT *, 'h_' || p_partkey % 40 || '_topic' AS k FROM c), t AS (SELECT 'h_' || p_partkey % 40 || '_topic' AS k, count(*) AS taken FROM part WHERE p_partkey % 40 < 5 AND p_partkey <= 80 GROUP BY ALL), n AS (SELECT id, k.k, row_number() OVER (PARTITION BY k.k ORDER BY url, id) + coalesce(taken, 0) AS n FROM k LEFT JOIN t USING (k)) SELECT k AS slug, n, count(*) AS hubs, CASE WHEN n = 1 THEN k ELSE k || '_' || n END AS hub FROM n GROUP BY ALL")
def hub_key_slugs(spark, d):
    """Keys for hubs from addresses, with numbers where they are taken or repeated."""
    n = F.col("p_partkey")
    part = read(spark, d, "part")
    candidates = part.select(n.alias("id"), _joined("http://p.org/x/", n % 40, " Topic/").alias("source_url"))
    existing = part.where((n % 40 < 5) & (n <= 80)).select(_joined("h_", n % 40, "_topic_", n).alias("hub"))
    made = catalog.hub_keys(candidates, existing)
    number = F.coalesce(F.nullif(F.regexp_extract("hub", r"_topic_(\d+)$", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return made.select(F.regexp_replace("hub", r"_topic_\d+$", "_topic").alias("slug"), number.alias("n"), "hub").groupBy("slug", "n", "hub").agg(F.count(F.lit(1)).alias("hubs")).select("slug", "n", "hubs", "hub")


@register("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * (vec_id % 3), 6) AS before, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS after FROM embeddings")
def unit_vectors(spark, d):
    """Vectors of several lengths scaled to one; zero vectors stay."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    norm = lambda v: F.round(F.sqrt(S.dot(v, v)), 6)
    return read(spark, d, "embeddings").select("vec_id", norm(scaled).alias("before"), norm(S.unit(scaled)).alias("after"))


@register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' ELSE 'html' END AS source_type FROM documents")
def typed_by_content(spark, d):
    """P5: source types by content type, else by address."""
    n = F.col("doc_id") % 4
    kind = F.when(n == 0, "Application/PDF").when(n == 1, "text/html; charset=utf-8")
    url = F.when(n == 2, "https://x.org/a/b.PDF?q=1").otherwise("https://x.org/a/b")
    return read(spark, d, "documents").select("doc_id", S.source_type(kind, url).alias("source_type"))
