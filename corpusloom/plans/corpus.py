"""Registered queries over documents, pages and the star schema: corpus, extraction, tables, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import catalog, chunk, corpus, extract, graph, tables
from ..operators import elements as E
from .shared import WHITE, read, register

NORM = f"trim(regexp_replace(lower(text), '{WHITE}', ' ', 'g'), ' ')"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"


# ---------------------------------------------------------------- corpus

RECORDS = f"r AS (SELECT doc_id AS input_pos, 'q' || doc_id AS qa_id, text AS question, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'html_accordion' END AS source_type, source AS topic_path, sha256({NORM}) AS k FROM documents), w AS (SELECT *, row_number() OVER o AS n, first_value(qa_id) OVER o AS kept FROM r WINDOW o AS (PARTITION BY k ORDER BY source_type = 'pdf' DESC, input_pos))"


def records(spark: SparkSession, d: str) -> DataFrame:
    doc = read(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("input_pos"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qa_id"), F.col("text").alias("question"), F.col("text").alias("answer"), F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("html_accordion").alias("source_type"), F.col("source").alias("topic_path"), F.lit("u").alias("source_url"), F.when(F.col("doc_id") % 2 == 0, "low").otherwise("high").alias("extraction_confidence"), F.array().cast("array<string>").alias("cross_refs"))


@register(f"WITH {RECORDS} SELECT input_pos, qa_id, source_type FROM w WHERE n = 1")
def priority_dedup(spark, d):
    return corpus.deduplicated(records(spark, d)).select("input_pos", "qa_id", "source_type")


@register(f"WITH {RECORDS} SELECT input_pos, qa_id AS dropped_qa_id, kept AS kept_qa_id FROM w WHERE n > 1")
def dedup_log(spark, d):
    return corpus.dedup_log(records(spark, d)).select("input_pos", "dropped_qa_id", "kept_qa_id")


@register(f"""WITH {RECORDS}, k AS (SELECT * FROM w WHERE n = 1), o AS (SELECT * FROM k WHERE NOT (input_pos % 2 = 0 AND length(question) < 100))
SELECT 'input' AS metric, '' AS name, count(*) AS value FROM r UNION ALL SELECT 'after_dedup', '', count(*) FROM k UNION ALL SELECT 'output', '', count(*) FROM o
UNION ALL SELECT 'by_source_type', source_type, count(*) FROM o GROUP BY source_type UNION ALL SELECT 'by_topic_path', topic_path, count(*) FROM o GROUP BY topic_path""")
def corpus_stats(spark, d):
    return corpus.build_corpus(records(spark, d))["stats"]


@register(f"WITH {RECORDS} SELECT qa_id FROM w WHERE n = 1 AND input_pos % 2 = 0 AND length(question) < 100")
def filter_log(spark, d):
    return corpus.build_corpus(records(spark, d))["filter_log"].select("qa_id")


@register("SELECT page_id, sha256(url) AS doc_id FROM pages")
def doc_ids(spark, d):
    return read(spark, d, "pages").select("page_id", S.doc_id(F.col("url")).alias("doc_id"))


@register(f"SELECT doc_id, substr(sha256(source || chr(0) || {NORM}), 1, 16) AS qa_id FROM documents")
def qa_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", S.qa_id(F.col("source"), F.col("text")).alias("qa_id"))


@register(f"SELECT doc_id, CASE WHEN length(q) > 240 THEN substr(q, 1, 240) || '…' ELSE q END AS quote FROM (SELECT doc_id, trim(regexp_replace(text, '{WHITE}', ' ', 'g'), ' ') AS q FROM documents)")
def quotes(spark, d):
    return read(spark, d, "documents").select("doc_id", S.quote(F.col("text")).alias("quote"))


SENTENCES = """s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')),
lambda s: length(s) >= 80 AND regexp_matches(substr(s, 1, 30), '\\p{Lu}') AND NOT starts_with(s, 'Rev.') AND NOT starts_with(s, 'See ')) AS x FROM documents), m AS (SELECT doc_id, CASE WHEN len(x) > 2 THEN x[2:len(x) - 1] ELSE x END AS x FROM s)"""


@register(f"WITH {SENTENCES} SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS sentence FROM m")
def sentences(spark, d):
    return corpus.sentences(read(spark, d, "documents"))


# one-letter sentences make two boundaries share a capital, which the marking pass of the oracle takes one at a time
WORDS = ("the", "tion", "der", "que", "ing", "sch", "eau", "and", "ado", "ble", "ment", "heit", "wh", "ción", "keit", "of", "aux", "est", "ung", "con")


@register("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in WORDS) + "], lambda c: contains(lower(text), c)), ',') AS concepts FROM documents")
def concept_tags(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(S.concepts_in(F.col("text"), list(WORDS)), ",").alias("concepts"))


TOKENS = "t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS t FROM documents)"


@register(f"""WITH {TOKENS}, s AS (SELECT doc_id, t, unnest(CASE WHEN len(t) <= 64 THEN [0] ELSE range(0, len(t) - 8, 56) END) AS start FROM t), c AS (SELECT doc_id, start, len(t[start + 1:start + 64]) AS token_count, array_to_string(t[start + 1:start + 64], ' ') AS text FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, token_count, sha256(text) AS text_sha FROM c WHERE length(text) >= 80""")
def flat_chunks(spark, d):
    """Texts without Markdown headings are one section."""
    return chunk.flat_chunks(read(spark, d, "documents"), size=64, overlap=8).select("doc_id", "chunk_index", "token_count", F.sha2("text", 256).alias("text_sha"))


@register(f"""WITH {TOKENS}, n AS (SELECT doc_id, t, ceil(len(t) / 256)::BIGINT AS a, ceil(len(t) / 64)::BIGINT AS b, ceil(len(t) / 16)::BIGINT AS c, sha256('u' || doc_id) AS d FROM t WHERE len(t) > 0),
w AS (SELECT *, 0 AS level, unnest(range(a)) AS w, 256 AS size, 0 AS base, NULL::BIGINT AS pnum FROM n UNION ALL SELECT doc_id, t, a, b, c, d, 1, w, 64, a, (w * 64) // 256 FROM (SELECT *, unnest(range(b)) AS w FROM n) UNION ALL SELECT doc_id, t, a, b, c, d, 2, w, 16, a + b, a + (w * 16) // 64 FROM (SELECT *, unnest(range(c)) AS w FROM n)),
x AS (SELECT d AS doc_id, substr(sha256(d || '|' || (base + w)), 1, 32) AS chunk_id, CASE WHEN pnum IS NOT NULL THEN substr(sha256(d || '|' || pnum), 1, 32) END AS parent_id, level, base + w AS chunk_index, level = 2 AS is_leaf, array_to_string(t[w * size + 1:w * size + size], ' ') AS text FROM w)
SELECT doc_id, chunk_id, parent_id, level, chunk_index, is_leaf, length(text) AS chars FROM x WHERE length(text) >= 80""")
def hier_chunks(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "text")
    return chunk.nested_chunks(docs, sizes=(256, 64, 16)).select("doc_id", "chunk_id", "parent_id", "level", "chunk_index", "is_leaf", F.length("text").alias("chars"))


# ---------------------------------------------------------------- addresses and pages


@register(f"""WITH p AS (SELECT page_id, url, {PATH} AS path, {SEGMENTS} AS s FROM pages), q AS (SELECT *, CASE WHEN contains(coalesce(s[-1], ''), '.') THEN s[1:len(s) - 1] ELSE s END AS f, regexp_extract(path, '([^/]*)$', 1) AS last FROM p)
SELECT page_id, CASE WHEN path = '' THEN 'unknown' WHEN NOT contains(last, '.') THEN 'html' WHEN lower(regexp_extract(last, '([^.]*)$', 1)) = 'pdf' THEN 'pdf' WHEN lower(regexp_extract(last, '([^.]*)$', 1)) IN ('html', 'htm') THEN 'html' ELSE 'unknown' END AS source_type,
CASE WHEN path <> '' THEN CASE WHEN len(f) > 0 THEN '/' || array_to_string(f, '/') || '/' ELSE '/' END END AS topic_path, '/' || array_to_string((CASE WHEN contains(coalesce(list_filter(s, lambda x: x <> 'en')[-1], ''), '.') THEN list_filter(s, lambda x: x <> 'en')[1:len(list_filter(s, lambda x: x <> 'en')) - 1] ELSE list_filter(s, lambda x: x <> 'en') END)[1:5], '/') AS topic_short,
array_to_string(CASE WHEN s[1] = 'en' THEN s[2:] ELSE s END, '/') AS site_path, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM q""")
def url_features(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", S.source_type_of_url(u).alias("source_type"), S.topic_path(u).alias("topic_path"), S.topic_path_short(u).alias("topic_short"), F.array_join(S.site_segments(F.lit(""), u), "/").alias("site_path"), S.url_host(u).alias("host"))


URL_RULES = (("feed", ("utm_source", "?page")), ("blog", ("//blog.",)), ("mobile", ("//m.",)), ("numbered", ("/1", "/2", "/3")))


@register("SELECT page_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(url), '{n}')" for n in ns) + f" THEN '{name}'" for name, ns in URL_RULES) + " ELSE 'other' END AS cluster, " + "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(url) || ' ', '{n}')" for n in ns) + f" THEN '{name}'" for name, ns in R.CATEGORY_RULES) + " ELSE 'other' END AS category, contains(lower(url), 'vet-') OR contains(lower(url), 'veterinary') OR contains(lower(url), '/vet/') OR contains(lower(url), 'animal-health') AS excluded FROM pages")
def source_category(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", R.topic_cluster(u, URL_RULES).alias("cluster"), R.row_category(F.lit(""), u).alias("category"), R.is_excluded(u).alias("excluded"))


@register(f"SELECT page_id, CASE WHEN regexp_matches(lower({PATH}), '\\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|csv)$') THEN 'file' WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'page' ELSE 'external' END AS kind FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM pages)")
def link_kind(spark, d):
    return read(spark, d, "pages").select("page_id", S.link_kind(F.col("url"), ("example.com",)).alias("kind"))


HREFS = "h AS (SELECT page_id, url, unnest(range(len(x))) AS pos, trim(replace(unnest(x), '&amp;', '&'), ' ') AS href FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1) AS x FROM pages))"


@register(f"WITH {HREFS} SELECT page_id, pos, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS tgt_url FROM h WHERE starts_with(href, '/') AND regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') <> regexp_replace(url, '#.*$', '')")
def page_links(spark, d):
    return extract.page_anchors(read(spark, d, "pages")).select("page_id", "pos", "tgt_url")


# pages with cards, files, badges and questions put into their articles
CRAFT = ("replace(replace(html, '<article>', '<article><div class=\"listing-item\"><a href=\"/card' || page_id || '\">Card</a></div><div class=\"bcl-file\" data-x-document-type=\"Leaflet\"><span class=\"file-title\">File <b>one</b></span><a href=\"/f' || page_id || '.pdf\">get</a></div><span class=\"x-bg-category\"><i>not</i><span class=\"label\">Human</span></span><span class=\"bg-topic\">Topic ' || page_id % 5 || '</span>'), "
    "'</article>', '<p>See <a href=\"/card' || page_id || '\">here</a><form><a href=\"/skipped\">s</a></form><div class=\"accordion-item\"><h2 class=\"accordion-header\">Q <button>Is it ' || page_id || '?</button></h2><div class=\"accordion-body\"><p>Yes<p>and <b>more</div></div><div class=\"accordion-item\"><h2 class=\"accordion-header\">No body</h2></div></article>')")


def crafted(spark, d):
    pages = read(spark, d, "pages")
    return pages.select("page_id", "url", F.expr(CRAFT).alias("html"))


def _quoted(*names: str) -> str:
    return ", ".join(f"'{n}'" for n in names)


_TAG, _DROPPED = (x.replace("'", "''") for x in (E.TAG, E.DROPPED))
#: Tokens and elements of a table g(page_id, url, html), numbered by their tags, and plain words after each tag.
ELEMENTS = f"""c AS (SELECT page_id, regexp_replace(coalesce(html, ''), '{_DROPPED}', ' ', 'g') AS clean FROM g),
k AS (SELECT page_id, unnest(range(len(x))) AS pos, unnest(list_concat([''], t)) AS tag, unnest(x) AS text FROM (SELECT page_id, regexp_extract_all(clean, '{_TAG}') AS t, string_split_regex(clean, '{_TAG}') AS x FROM c)),
n AS (SELECT page_id, pos, text, lower(regexp_extract(tag, '^{_TAG}$', 2)) AS name, regexp_extract(tag, '^{_TAG}$', 3) AS attrs, starts_with(tag, '</') AS closing FROM k),
s AS (SELECT *, CASE WHEN name = '' OR name IN ({_quoted(*E.VOID)}) OR ends_with(attrs, '/') THEN 0 WHEN closing THEN -1 ELSE 1 END AS side FROM n),
o AS (SELECT *, sum(side) OVER (PARTITION BY page_id, name ORDER BY pos) - CASE WHEN side = 1 THEN 1 ELSE 0 END AS nest FROM s),
m AS (SELECT page_id, pos, CASE WHEN lead(side) OVER w = -1 THEN lead(pos) OVER w END AS stop FROM o WHERE side <> 0 WINDOW w AS (PARTITION BY page_id, name, nest ORDER BY pos)),
p AS (SELECT s.*, m.stop FROM s LEFT JOIN m ON m.page_id = s.page_id AND m.pos = s.pos AND s.side = 1),
h AS (SELECT page_id, pos, stop FROM p WHERE stop IS NOT NULL AND name IN ({_quoted(*E.CONTAINERS)})),
u AS (SELECT p.page_id, p.pos, min(h.stop) AS around FROM p JOIN h ON h.page_id = p.page_id AND h.pos < p.pos AND p.pos < h.stop WHERE p.side = 1 AND p.stop IS NULL GROUP BY ALL),
b AS (SELECT p.page_id, p.pos, min(q.pos) AS block FROM p JOIN p q ON q.page_id = p.page_id AND q.pos > p.pos AND NOT q.closing AND q.name IN ({_quoted(*E.BLOCKS)}) WHERE p.side = 1 AND p.stop IS NULL AND p.name NOT IN ({_quoted(*E.CONTAINERS)}) GROUP BY ALL),
z AS (SELECT page_id, count(*) AS size FROM p GROUP BY page_id),
e AS (SELECT p.page_id, p.pos AS pre, CASE WHEN side = 0 THEN p.pos ELSE coalesce(stop, least(coalesce(around, size), coalesce(block, size))) END AS post, name, attrs,
  regexp_extract(attrs, '(?is)(?:^|[\\s"''/])class\\s*=\\s*"([^"]*)"', 1) AS cls, regexp_extract(attrs, '(?is)(?:^|[\\s"''/])href\\s*=\\s*"([^"]*)"', 1) AS href FROM p JOIN z USING (page_id) LEFT JOIN u USING (page_id, pos) LEFT JOIN b USING (page_id, pos) WHERE name <> '' AND NOT closing),
x AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(replace(replace(replace(text, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM p)"""


def _of_class(alias: str, name: str) -> str:
    return f"regexp_matches({alias}.cls, '(?:^|\\s)(?:{name})(?:\\s|$)')"


def _inside(inner: str, outer: str, at: str = "pre") -> str:
    return f"{outer}.page_id = {inner}.page_id AND {outer}.pre {'<' if at == 'pre' else '<='} {inner}.{at} AND {inner}.{at} < {outer}.post"


@register(f"WITH g AS (SELECT * FROM pages), {ELEMENTS} SELECT page_id, pre, post, name FROM e")
def element_table(spark, d):
    """Elements of pages, numbered by their start and end tags; some have no end tag."""
    return E.tokens(read(spark, d, "pages")).where("post is not null").select("page_id", F.col("pos").alias("pre"), "post", "name")


HOST = "regexp_extract(g.url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


@register(f"""WITH g AS (SELECT page_id, url, {CRAFT} AS html FROM pages), {ELEMENTS}, root AS (SELECT page_id, min(pre) AS pre, arg_min(post, pre) AS post FROM e WHERE name = 'body' GROUP BY page_id),
l AS (SELECT e.page_id, e.pre, e.post, e.href, (SELECT max(f.pre) FROM e f WHERE {_inside("e", "f")} AND {_of_class("f", "bcl-file")}) AS file, EXISTS (SELECT 1 FROM e f WHERE {_inside("e", "f")} AND {_of_class("f", "|".join(extract.CARD_CLASSES))}) AS card,
  EXISTS (SELECT 1 FROM e f WHERE {_inside("e", "f")} AND f.name IN ({_quoted(*extract.TEXT_TAGS)})) AS flow, EXISTS (SELECT 1 FROM e f WHERE {_inside("e", "f")} AND (f.name IN ('button', 'form') OR {_of_class("f", "|".join(extract.SKIP_CLASSES))})) AS skip
  FROM e JOIN root r ON {_inside("e", "r")} WHERE e.name = 'a' AND e.href <> ''),
y AS (SELECT l.*, CASE WHEN file IS NOT NULL THEN 3 WHEN card THEN 2 WHEN flow THEN 1 ELSE 0 END AS priority, (SELECT string_agg(t, ' ' ORDER BY pos) FROM x WHERE x.page_id = l.page_id AND l.pre <= pos AND pos < l.post AND t <> '') AS own,
  (SELECT string_agg(t, ' ' ORDER BY pos) FROM x JOIN e f ON {_inside("x", "f", "pos")} AND {_of_class("f", "file-title")} JOIN e q ON q.page_id = f.page_id AND q.pre = l.file AND q.pre < f.pre AND f.pre < q.post WHERE x.page_id = l.page_id AND t <> '') AS title FROM l WHERE NOT skip),
w AS (SELECT y.page_id, {HOST} || regexp_replace(replace(href, '&amp;', '&'), '#.*$', '') AS tgt_url, lower(regexp_extract(g.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_replace(g.url, '#.*$', '') AS self, coalesce(title, own, '') AS anchor, priority, pre FROM y JOIN g USING (page_id) WHERE starts_with(href, '/'))
SELECT page_id, tgt_url, anchor[1:200] AS anchor, CASE WHEN regexp_matches(lower(tgt_url), '^[^?#]*\\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|csv)$') THEN 'file' WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'page' ELSE 'external' END AS kind, CASE priority WHEN 3 THEN 'file_component' WHEN 2 THEN 'card_or_listing' WHEN 1 THEN 'inline' ELSE 'other' END AS link_context, CASE WHEN priority = 3 THEN 'Leaflet' END AS document_type
FROM w WHERE tgt_url <> self QUALIFY row_number() OVER (PARTITION BY page_id, tgt_url ORDER BY priority DESC, pre) = 1""")
def content_links(spark, d):
    """Links of pages with their contexts; a target that has several keeps the richest."""
    pages = crafted(spark, d)
    found = extract.page_elements(pages, root_tag="body", root_class=None, skip_tags=("button", "form")).join(pages.select("page_id", "url"), "page_id")
    return extract.typed_links(found, domains=("example.com",)).select("page_id", "tgt_url", "anchor", "kind", "link_context", "document_type")


@register(f"""WITH g AS (SELECT page_id, url, {CRAFT} AS html FROM pages), {ELEMENTS}, f AS (SELECT e.page_id, min(e.pre) AS pre, arg_min(e.post, e.pre) AS post, which FROM e JOIN (VALUES ('audience', '\\S*bg-category'), ('site_topic', '\\S*bg-topic')) v(which, pattern) ON regexp_matches(cls, '(?:^|\\s)(?:' || pattern || ')(?:\\s|$)') WHERE name = 'span' GROUP BY e.page_id, which),
q AS (SELECT f.page_id, which, coalesce(min(b.pre), f.pre) AS pre, coalesce(arg_min(b.post, b.pre), f.post) AS post FROM f LEFT JOIN e b ON {_inside("b", "f")} AND b.name = 'span' AND {_of_class("b", "label")} GROUP BY f.page_id, which, f.pre, f.post),
t AS (SELECT q.page_id, which, string_agg(t, ' ' ORDER BY pos) AS text FROM q JOIN x ON {_inside("x", "q", "pos")} WHERE t <> '' GROUP BY ALL)
SELECT g.page_id, max(text) FILTER (WHERE which = 'audience') AS audience, max(text) FILTER (WHERE which = 'site_topic') AS site_topic FROM g LEFT JOIN t USING (page_id) GROUP BY g.page_id""")
def page_badges(spark, d):
    """X11: audience and topic badges of pages."""
    return extract.page_elements(crafted(spark, d), root_tag="article", root_class=None).select("page_id", "audience", "site_topic")


@register(f"""WITH g AS (SELECT page_id, url, {CRAFT} AS html FROM pages), {ELEMENTS}, i AS (SELECT * FROM e WHERE {_of_class("e", "accordion-item")}),
a AS (SELECT i.page_id, i.pre, (SELECT string_agg(t, ' ' ORDER BY pos) FROM x JOIN e b ON {_inside("x", "b", "pos")} AND b.name = 'button' AND {_inside("b", "i")} WHERE t <> '') AS button, (SELECT string_agg(t, ' ' ORDER BY pos) FROM x JOIN e b ON {_inside("x", "b", "pos")} AND {_of_class("b", "accordion-header")} AND {_inside("b", "i")} WHERE t <> '') AS heading,
  (SELECT string_agg(t, ' ' ORDER BY pos) FROM x JOIN e b ON {_inside("x", "b", "pos")} AND {_of_class("b", "accordion-body")} AND {_inside("b", "i")} WHERE t <> '') AS answer FROM i)
SELECT page_id, coalesce(button, heading) AS question, answer FROM a WHERE answer IS NOT NULL AND coalesce(button, heading) IS NOT NULL""")
def accordion_questions(spark, d):
    """Questions and answers of accordion items."""
    pages = crafted(spark, d)
    found = extract.page_elements(pages).join(pages.select("page_id", "url"), "page_id")
    records = extract.accordion_qa(found, url="page_id")
    return records.select(F.col("source_url").alias("page_id"), "question", "answer")


@register(f"""WITH g AS (SELECT page_id, url, {CRAFT} AS html FROM pages), {ELEMENTS}, r AS (SELECT page_id, min(pre) AS pre, arg_min(post, pre) AS post FROM e WHERE name = 'article' GROUP BY page_id),
y AS (SELECT x.page_id, x.pos, t, (SELECT count(*) FROM p WHERE p.page_id = x.page_id AND r.pre <= p.pos AND p.pos <= x.pos AND p.name IN ({_quoted(*extract.LINE_TAGS)})) AS line FROM x JOIN r ON {_inside("x", "r", "pos")} WHERE t <> '' AND NOT EXISTS (SELECT 1 FROM e f WHERE {_inside("x", "f", "pos")} AND f.name IN ({_quoted(*extract.SKIP_TAGS)}))),
l AS (SELECT page_id, line, string_agg(t, ' ' ORDER BY pos) AS t FROM y GROUP BY ALL), t AS (SELECT page_id, string_agg(t, chr(10) ORDER BY line) AS main_text FROM l GROUP BY page_id)
SELECT page_id, length(coalesce(main_text, '')) AS extracted_chars, CASE WHEN coalesce(main_text, '') = '' THEN 'empty_input' WHEN length(main_text) < 200 THEN 'landing_page_below_min_chars' ELSE '' END AS error, sha256(coalesce(main_text, '')) AS text_sha FROM g LEFT JOIN t USING (page_id)""")
def main_text(spark, d):
    """The text of pages' articles, a line for each block."""
    found = extract.parsed_pages(extract.page_elements(crafted(spark, d), root_tag="article", root_class=None))
    return found.select("page_id", "extracted_chars", "error", F.sha2("main_text", 256).alias("text_sha"))


@register("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '&amp;', '&amp;'), '&quot;', '&quot;'), '&lt;', '&lt;'), '&gt;', '&gt;'), '\\s+', ' ', 'g'), ' ')[1:200] AS title FROM pages")
def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", S.html_title(F.col("html")).alias("title"))


# ---------------------------------------------------------------- label tables


@register("SELECT d.source AS source_type, count(*) AS docs, count(l.quality) AS labelled, round(avg((l.quality IS NOT NULL)::DOUBLE), 6) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def label_coverage(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("source_type"))
    return tables.label_coverage(docs, read(spark, d, "labels"), "quality")


@register("SELECT coalesce(d.doc_id, l.doc_id) AS url, CASE WHEN l.doc_id IS NOT NULL THEN nullif(l.toxic, 0) ELSE d.n_chars % 3 END AS toxic, CASE WHEN l.doc_id IS NOT NULL THEN 'v2' END AS provenance_badges FROM documents d FULL JOIN labels l USING (doc_id)")
def label_upsert(spark, d):
    old = read(spark, d, "documents").select(F.col("doc_id").alias("url"), (F.col("n_chars") % 3).alias("toxic"))
    new = read(spark, d, "labels").select(F.col("doc_id").alias("url"), F.nullif(F.col("toxic").cast("long"), F.lit(0).cast("long")).alias("toxic"))
    return tables.upsert_labels(old, new, ["toxic"], group="badges", stamp=F.lit("v2"))


@register("WITH n AS (SELECT doc_id, ['b', 'd'][1:1 + quality] AS h FROM labels) SELECT d.doc_id AS url, array_to_string(list_sort(list_distinct(list_concat(list_filter(['a', 'b'][1:1 + d.doc_id % 2], lambda x: x NOT IN ('b', 'd')), coalesce(n.h, [])))), ',') AS hubs FROM documents d LEFT JOIN n USING (doc_id)")
def hub_upsert(spark, d):
    old = read(spark, d, "documents").select(F.col("doc_id").alias("url"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("doc_id") % 2 + 1).cast("int")).alias("topic_hubs"))
    new = read(spark, d, "labels").select(F.col("doc_id").alias("url"), F.slice(F.array(F.lit("b"), F.lit("d")), 1, (F.col("quality") + 1).cast("int")).alias("topic_hubs"))
    return tables.upsert_hubs(old, new, ["b", "d"]).select("url", F.array_join("topic_hubs", ",").alias("hubs"))


@register("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark, d):
    return graph.without_chunks(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"))


@register("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN nullif(l.toxic, 0) WHEN d.doc_id % 3 <> 0 THEN 7 END AS audience, l.doc_id IS NOT NULL AS label_found FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_join(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("url"), F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("html").alias("source_type"))
    meta = read(spark, d, "labels").select(F.col("doc_id").alias("url"), F.nullif(F.col("toxic").cast("long"), F.lit(0).cast("long")).alias("audience"))
    badges = docs.select("url", F.lit(7).cast("long").alias("audience"))
    return tables.label_documents(docs, meta, badges, ["audience"]).select("doc_id", "audience", "label_found")


@register("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_propagation(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return tables.propagate(docs, read(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars")), ["n_chars"])


# ---------------------------------------------------------------- graph

LINKS = "links AS (SELECT l_partkey AS src, l_suppkey AS tgt, l_returnflag || l_linestatus AS anchor, l_returnflag AS link_context, l_linestatus AS kind FROM lineitem)"


def links(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt"), F.concat("l_returnflag", "l_linestatus").alias("anchor"), F.col("l_returnflag").alias("link_context"), F.col("l_linestatus").alias("kind"))


@register(f"WITH {LINKS} SELECT tgt AS doc_id, count(*) AS degree FROM links GROUP BY tgt")
def link_degree(spark, d):
    return graph.degrees(links(spark, d))


@register(f"WITH {LINKS}, g AS (SELECT tgt, count(*) AS n FROM links GROUP BY tgt), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tgt) AS r FROM g) SELECT sum(n)::BIGINT AS edges, median(n)::DOUBLE AS median_degree, max(n) AS max_degree, " + ", ".join(f"round(sum(n) FILTER (WHERE r <= {k}) / sum(n), 6) AS share_{k}" for k in (1, 10, 50, 100)) + " FROM r")
def link_concentration(spark, d):
    return graph.concentration(links(spark, d))


@register(f"WITH {LINKS} SELECT anchor, count(*) AS uses, count(DISTINCT src) AS sources FROM links GROUP BY anchor ORDER BY uses DESC, anchor LIMIT 20")
def top_anchors(spark, d):
    return graph.repeated_anchors(links(spark, d))


@register(f"WITH {LINKS} SELECT link_context, kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM links GROUP BY ALL")
def edge_histogram(spark, d):
    return graph.edge_histogram(links(spark, d))


@register("SELECT coalesce(p_brand, '(none)') AS value, count(*) AS n FROM part GROUP BY ALL")
def label_histogram(spark, d):
    return graph.histogram(read(spark, d, "part"), "p_brand")


@register("SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'links', count(*) FROM lineitem")
def graph_census(spark, d):
    return graph.census(part=read(spark, d, "part"), supplier=read(spark, d, "supplier"), links=links(spark, d))


@register("SELECT l_linestatus AS source_type, count(*) AS rows, count(l_returnflag) AS l_returnflag, count(nullif(l_returnflag, 'N')) AS flagged FROM lineitem GROUP BY ALL")
def enrichment_coverage(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_linestatus").alias("source_type"), "l_returnflag", F.nullif("l_returnflag", F.lit("N")).alias("flagged"))
    return graph.coverage(rows, ["l_returnflag", "flagged"])


N = "(SELECT max(p_partkey) + 1 FROM part)"
PARTS = f"p AS (SELECT p_partkey AS id, p_brand AS category, p_partkey % 7 AS audience FROM part), e AS (SELECT DISTINCT src, tgt FROM (SELECT id AS src, (id * 7 + 3) % {N} AS tgt FROM p UNION ALL SELECT id, (id * 11 + 5) % {N} FROM p))"


def part_docs(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.col("p_brand").alias("category"), F.lit(None).cast("string").alias("doc_type"), (F.col("p_partkey") % 7).cast("string").alias("audience"))


def part_edges(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("src"))
    n = p.agg((F.max("src") + 1).alias("n"))
    return p.crossJoin(F.broadcast(n)).select("src", F.explode(F.array((F.col("src") * 7 + 3) % F.col("n"), (F.col("src") * 11 + 5) % F.col("n"))).alias("tgt")).distinct()


def part_hubs(spark, d):
    """One hub per brand: its smallest part is the seed; two hops over parts of three brands."""
    brands = read(spark, d, "part").groupBy(F.col("p_brand").alias("hub")).agg(F.min("p_partkey").cast("long").alias("seed"))
    return brands.select("hub", "seed", F.lit(2).alias("hops"), F.array(F.col("hub"), F.lit("Brand#11"), F.lit("Brand#23"), F.lit("Brand#34")).alias("categories"), F.array().cast("array<string>").alias("doc_types"), F.array(F.lit("3")).alias("exclude_audience"))


WALK = f"""{PARTS}, h AS (SELECT category AS hub, min(id) AS seed FROM p GROUP BY category), q AS (SELECT h.hub, p.id FROM h, p WHERE (p.category = h.hub OR p.category IN ('Brand#11', 'Brand#23', 'Brand#34')) AND p.audience <> 3),
m1 AS (SELECT DISTINCT h.hub, e.tgt AS id FROM h JOIN e ON e.src = h.seed JOIN q ON q.hub = h.hub AND q.id = e.tgt WHERE e.tgt <> h.seed), m2 AS (SELECT DISTINCT m1.hub, e.tgt AS id FROM m1 JOIN e ON e.src = m1.id JOIN q ON q.hub = m1.hub AND q.id = e.tgt),
m AS (SELECT hub, seed AS id, 0 AS hop FROM h UNION ALL SELECT hub, id, 1 FROM m1 UNION ALL SELECT hub, id, 2 FROM m2 WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.hub = m2.hub AND m1.id = m2.id) AND NOT EXISTS (SELECT 1 FROM h WHERE h.hub = m2.hub AND h.seed = m2.id))"""


@register(f"WITH {WALK} SELECT hub, id AS doc_id, hop FROM m")
def qualified_walk(spark, d):
    return graph.qualified_walk(part_hubs(spark, d), part_docs(spark, d), part_edges(spark, d), most_hops=2)


@register(f"WITH {WALK} SELECT id AS doc_id, array_to_string(list_sort(list(DISTINCT hub)), ',') AS hubs FROM m GROUP BY id")
def membership(spark, d):
    return graph.memberships(graph.qualified_walk(part_hubs(spark, d), part_docs(spark, d), part_edges(spark, d), most_hops=2)).select("doc_id", F.array_join("topic_hubs", ",").alias("hubs"))


@register(f"WITH {WALK} SELECT hub, count(*) AS members FROM m GROUP BY hub")
def hub_sizes(spark, d):
    return graph.hub_sizes(graph.memberships(graph.qualified_walk(part_hubs(spark, d), part_docs(spark, d), part_edges(spark, d), most_hops=2)))


@register("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS tgt, l_returnflag = 'R' AS curated FROM lineitem), o AS (SELECT src, count(*) FILTER (WHERE curated) AS c, count(*) FILTER (WHERE NOT curated) AS i FROM e JOIN part ON p_partkey = tgt WHERE p_size > 10 GROUP BY src),
s AS (SELECT o.*, s_nationkey % 5 AS a, s_name, 2 * c + i AS score FROM o JOIN supplier ON s_suppkey = src WHERE c + i >= 5 ORDER BY score DESC, src LIMIT 50) SELECT src AS doc_id, c AS curated, i AS inline, round(score * CASE WHEN contains(s_name, '7') THEN 0.1 ELSE 1.0 END * CASE WHEN a = 0 THEN 0.2 ELSE 1.0 END, 6)::DOUBLE AS score FROM s""")
def hub_candidates(spark, d):
    edges = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"), (F.col("l_returnflag") == "R").alias("curated")).distinct()
    targets = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("audience"), (F.col("p_size") > 10).alias("good"), F.lit(False).alias("hub"))
    return _candidates(edges, targets, read(spark, d, "supplier"))


def _candidates(edges, targets, suppliers):
    """Suppliers link to parts: two id spaces, so suppliers' ids are shifted out of the parts' range and back."""
    far = 1 << 40
    docs = targets.unionByName(suppliers.select((F.col("s_suppkey") + far).alias("doc_id"), F.col("s_name").alias("title"), (F.col("s_nationkey") % 5).cast("string").alias("audience"), F.lit(False).alias("good"), F.lit(True).alias("hub")))
    out = graph.hub_candidates(docs, edges.withColumn("src", F.col("src") + far), qualifies=F.col("good"), curated=F.col("curated"), overview=F.col("hub"), stale="7", penalised=("0",))
    return out.select((F.col("doc_id") - far).alias("doc_id"), "curated", "inline", "score")


# site tree: regions and nations are pages, customers pages below them, orders PDFs linked from customers
TREE = """n AS (SELECT 'r' || r_regionkey AS doc_id, FALSE AS pdf, ['reg' || r_regionkey] AS path FROM region UNION ALL SELECT 'n' || n_nationkey, FALSE, ['reg' || n_regionkey, 'nat' || n_nationkey] FROM nation WHERE n_nationkey % 4 <> 3
UNION ALL SELECT 'c' || c_custkey, FALSE, ['reg' || n_regionkey, 'nat' || n_nationkey, 'cus' || c_custkey] FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'o' || o_orderkey, TRUE, ['docs', 'y' || o_orderkey % 5] FROM orders),
l AS (SELECT 'o' || o_orderkey AS doc_id, 'c' || o_custkey AS linker FROM orders WHERE o_orderkey % 3 <> 0), occ AS (SELECT path, min(doc_id) AS occupant FROM n WHERE NOT pdf GROUP BY path),
f AS (SELECT n.doc_id, n.path, CASE WHEN pdf THEN n.path ELSE n.path[1:len(n.path) - 1] END AS section FROM n LEFT JOIN l USING (doc_id) WHERE l.linker IS NULL),
x AS (SELECT f.doc_id, f.path, f.section, unnest(range(1, len(f.section) + 1)) AS i FROM f), a AS (SELECT x.doc_id, i, occupant FROM x JOIN occ ON occ.path = x.section[1:i] WHERE occupant <> x.doc_id),
g AS (SELECT doc_id, list(occupant ORDER BY i) AS line, arg_max(occupant, i) AS near, max(i) AS reach FROM a GROUP BY doc_id),
t AS (SELECT f.doc_id, CASE WHEN g.reach = len(f.section) THEN g.near END AS parent_id, len(f.section) + 1 AS depth, f.path, coalesce(g.line, []::VARCHAR[]) AS line FROM f LEFT JOIN g USING (doc_id)),
u AS (SELECT * FROM t UNION ALL SELECT l.doc_id, l.linker, t.depth + 1, t.path, list_append(t.line, l.linker) FROM l JOIN t ON t.doc_id = l.linker)"""


def tree_records(spark, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, customer, orders = (read(spark, d, t) for t in ("nation", "customer", "orders"))
    path = lambda *parts: F.concat(F.lit("/"), F.concat_ws("/", *parts))
    none = F.lit(None).cast("string").alias("source_url")
    region = read(spark, d, "region").select(text("r", "r_regionkey").alias("doc_id"), F.lit("html").alias("source_type"), path(text("reg", "r_regionkey")).alias("topic_path"), none)
    nations = nation.where("n_nationkey % 4 <> 3").select(text("n", "n_nationkey").alias("doc_id"), F.lit("html").alias("source_type"), path(text("reg", "n_regionkey"), text("nat", "n_nationkey")).alias("topic_path"), none)
    customers = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(text("c", "c_custkey").alias("doc_id"), F.lit("html").alias("source_type"), path(text("reg", "n_regionkey"), text("nat", "n_nationkey"), text("cus", "c_custkey")).alias("topic_path"), none)
    files = orders.select(text("o", "o_orderkey").alias("doc_id"), F.lit("pdf").alias("source_type"), path(F.lit("docs"), F.concat(F.lit("y"), (F.col("o_orderkey") % 5).cast("string"))).alias("topic_path"), none)
    edges = orders.where("o_orderkey % 3 <> 0").select(text("c", "o_custkey").alias("src"), text("o", "o_orderkey").alias("tgt"))
    return graph.tree_records(region.unionByName(nations).unionByName(customers).unionByName(files), edges)


@register(f"WITH {TREE} SELECT doc_id, parent_id, depth, array_to_string(path, '/') AS path, array_to_string(line, ',') AS ancestors FROM u")
def site_tree(spark, d):
    return tree_records(spark, d).select("doc_id", "parent_id", "depth", F.array_join("path", "/").alias("path"), F.array_join("ancestor_ids", ",").alias("ancestors"))


@register(f"WITH {TREE} SELECT depth, count(*) AS docs, count(parent_id) AS parented FROM u GROUP BY depth")
def tree_depths(spark, d):
    return graph.depth_histogram(tree_records(spark, d))


@register(f"WITH {TREE}, b AS (SELECT a AS doc_id, count(*) AS n FROM (SELECT unnest(line) AS a FROM u) GROUP BY a) SELECT u.doc_id, greatest(coalesce(b.n, 0), 1) AS weight FROM u LEFT JOIN b USING (doc_id)")
def subtree_counts(spark, d):
    return graph.subtree_counts(tree_records(spark, d))


@register("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + p_size % 3 AS b FROM part WHERE p_size % 3 > 0), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node), z AS (SELECT component, count(*) AS size FROM c GROUP BY component) SELECT node, component, size, size < 3 AS is_small FROM c JOIN z USING (component)""")
def components(spark, d):
    p = read(spark, d, "part").where("p_size % 3 > 0")
    return graph.components(p.select(F.col("p_partkey").cast("long").alias("src"), (F.col("p_partkey") + F.col("p_size") % 3).cast("long").alias("tgt")))


@register("SELECT l_suppkey AS doc_id, count(*) AS links FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY ALL")
def resolved_edges(spark, d):
    docs = read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("doc_id"))
    edges = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"))
    return graph.resolved_edges(edges, docs, one_way=True).groupBy(F.col("src").alias("doc_id")).agg(F.count(F.lit(1)).alias("links"))


@register("""WITH v AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)), g AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT p_partkey AS doc_id, coalesce(i, -1) AS p_brand_index, coalesce(n, 0) AS in_degree FROM part LEFT JOIN v USING (p_brand) LEFT JOIN g ON id = p_partkey""")
def map_payload(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand")
    edges = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"))
    return tables.map_payload(nodes, edges, ["p_brand"]).select("doc_id", "p_brand_index", "in_degree")


MEMBERS = "m AS (SELECT o_orderpriority AS hub, o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'html' ELSE 'pdf' END AS st FROM orders), e AS (SELECT o_orderkey - 2 AS src, o_orderkey AS tgt FROM orders UNION ALL SELECT o_orderkey - 1, o_orderkey FROM orders), g AS (SELECT f.hub, f.doc_id, min(p.doc_id) AS p FROM m f JOIN e ON e.tgt = f.doc_id JOIN m p ON p.doc_id = e.src AND p.hub = f.hub WHERE f.st = 'pdf' AND p.st = 'html' GROUP BY ALL)"


def members(spark, d):
    o = read(spark, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("hub"), F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, "html").otherwise("pdf").alias("source_type"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("title"))
    edges = o.select(F.col("o_orderkey").alias("tgt"), F.explode(F.array(F.col("o_orderkey") - 2, F.col("o_orderkey") - 1)).alias("src"))
    return rows, edges


@register(f"WITH {MEMBERS} SELECT m.hub, m.doc_id, coalesce(g.p, m.doc_id) AS group_id FROM m LEFT JOIN g USING (hub, doc_id)")
def grouped_members(spark, d):
    return catalog.grouped_members(*members(spark, d)).select("hub", "doc_id", "group_id")


@register(f"""WITH {MEMBERS}, k AS (SELECT m.hub, m.doc_id, coalesce(g.p, m.doc_id) AS group_id, CASE WHEN m.doc_id % 5 <> 0 THEN (m.doc_id % 13) / 10 END AS score FROM m LEFT JOIN g USING (hub, doc_id)), x AS (SELECT hub, group_id, max(score) AS score, count(*) AS members, 't' || group_id AS title FROM k GROUP BY hub, group_id),
y AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY score DESC NULLS LAST, title, group_id) AS place, count(*) OVER (PARTITION BY hub) AS total FROM x) SELECT hub, group_id, score, members, title, place, total FROM y WHERE place <= 20""")
def topic_catalog(spark, d):
    rows, edges = members(spark, d)
    scores = rows.where("doc_id % 5 <> 0").select("doc_id", ((F.col("doc_id") % 13) / 10).alias("score"))
    return catalog.topic_catalog(rows, edges, scores).select("hub", "group_id", "score", "members", "title", "place", "total")


@register("SELECT doc_id, length(text) AS chars FROM documents")
def incremental_docs(spark, d):
    """Documents through a file stream that runs to its end, as a batch table."""
    from ..streaming import incremental

    target = incremental.scratch(spark)
    schema = read(spark, d, "documents").select("doc_id", "text").schema
    query = incremental.resumable_build(spark, f"{d}/documents.parquet", schema, f"{target}/out", f"{target}/state", lambda b: b.select("doc_id", F.length("text").alias("chars")))
    query.awaitTermination()
    return spark.read.parquet(f"{target}/out").select("doc_id", "chars")


@register("""WITH r AS (SELECT l_orderkey AS k, l_partkey, l_quantity, l_linenumber AS batch FROM lineitem), x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, batch ORDER BY l_partkey DESC, l_quantity DESC) = 1)
SELECT CASE WHEN k % 50 <> 0 THEN k END AS k, l_partkey, l_quantity FROM x WHERE k % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch DESC) = 1
UNION ALL (SELECT NULL, l_partkey, l_quantity FROM r WHERE k % 50 = 0 QUALIFY row_number() OVER (ORDER BY batch DESC, l_partkey DESC, l_quantity DESC) = 1)""")
def upserted_table(spark, d):
    """The lines of orders put into a keyed table, first those with number one, each change twice; some keys are null."""
    from ..streaming import incremental, keyed

    lines = read(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 50 != 0, F.col("l_orderkey")).alias("k"), "l_partkey", "l_quantity", "l_linenumber")
    target = incremental.scratch(spark)
    for number in range(1, 8):
        for _ in range(2):
            keyed.put(lines.where(F.col("l_linenumber") == number).drop("l_linenumber"), target, ["k"], number, buckets=16)
    return keyed.table(spark, target)


@register("""WITH r AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS batch FROM lineitem), m AS (SELECT batch, k, max(l_partkey) FILTER (WHERE TRUE) AS p FROM (SELECT l_orderkey AS k, l_linenumber AS batch, l_partkey % 5 AS l_partkey FROM lineitem) GROUP BY ALL),
o AS (SELECT batch, k, p, lag(p) OVER (PARTITION BY k ORDER BY batch) AS before FROM m) SELECT batch, count(before) AS matched, count(*) FILTER (WHERE before IS NOT NULL AND before <> p) AS modified, count(*) FILTER (WHERE before IS NULL) AS upserted FROM o GROUP BY batch""")
def upsert_counts(spark, d):
    """How many keys each change of a keyed table matched, changed and added."""
    from ..streaming import incremental, keyed

    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 5).alias("p"), "l_linenumber")
    target = incremental.scratch(spark)
    counts = [(n, *keyed.put(lines.where(F.col("l_linenumber") == n).drop("l_linenumber"), target, ["k"], n, buckets=8).values()) for n in range(1, 8)]
    return spark.createDataFrame(counts, "batch long, matched long, modified long, upserted long")


@register("SELECT c_mktsegment AS cluster, count(*) FILTER (WHERE c_custkey % 2 = 0) AS pages, count(*) FILTER (WHERE c_custkey % 2 = 1) AS pdfs, sum(c_custkey % 4)::BIGINT AS questions, FALSE AS thin, round(100 * sum(c_custkey % 3) / (sum(c_custkey % 5) + sum(c_custkey % 3)), 1) AS completeness FROM customer GROUP BY ALL")
def cluster_report(spark, d):
    from ..operators.evaluate import cluster_report as report

    c = F.col("c_custkey")
    return report(read(spark, d, "customer").select(F.col("c_mktsegment").alias("cluster"), F.when(c % 2 == 0, "html").otherwise("pdf").alias("type"), (c % 4).alias("q_count"), (c % 5).alias("textual"), (c % 3).alias("known_links")))


@register("SELECT count(*) AS sources, count(*) FILTER (WHERE c_custkey % 2 = 0) AS pages, count(*) FILTER (WHERE c_custkey % 2 = 1) AS pdfs, sum(c_custkey % 4)::BIGINT AS questions, CASE WHEN sum(c_custkey % 4) >= 500 THEN 'go' ELSE 'no-go' END AS verdict FROM customer")
def inventory_summary(spark, d):
    from ..operators.evaluate import inventory_summary as summary

    c = F.col("c_custkey")
    return summary(read(spark, d, "customer").select(F.when(c % 2 == 0, "html").otherwise("pdf").alias("type"), (c % 4).alias("q_count")))
