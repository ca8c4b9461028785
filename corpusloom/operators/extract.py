"""Table-generating extraction: one page or text in, many rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import stored
from . import elements as E

#: Patterns of question headings, references and mentions.
QA_HEADING = r"(?m)^#{1,3}\s+(?:\*{1,2})?\s*(\d+)\.\s+(.+?)(?:\*{1,2})?$"
STOP_SECTION = r"(?im)^#{1,3}\s+(?:\*{1,2})?\s*(?:References?|Annex|Appendix|Bibliography)"
CROSS_REFERENCE = r"(?i)see\s+(?:q&a|question|q)\s+(\d+)"
SEE_QA = r"(?i)\b(?:see\s+(?:Q\s*&\s*A|Q\s*and\s*A)\s*(?:no\.?|number)?\s*(\d+)|see\s+question\s+(?:no\.?|number)?\s*(\d+))"
MARKDOWN_LINK = r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)"
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)(?=</a>|<a\b|$)"""
SKIPPED_SCHEMES = r"(?i)^(mailto|tel|javascript|data|blob):"
SKIP_TAGS = tuple("script style noscript svg button form input nav".split())
SKIP_CLASSES = ("bcl-inpage-navigation", "breadcrumb", "dropdown-menu")
TEXT_TAGS = tuple("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote ul ol dl table".split())
CARD_CLASSES = ("bcl-listing", "listing-item", "bcl-content-banner")
#: Elements whose start and end tags end a line of the main text.
LINE_TAGS = (*E.BLOCKS, "br")
CONTEXT_PRIORITY = {"file_component": 3, "card_or_listing": 2, "inline": 1, "other": 0}


def _decoded(x: Column) -> Column:
    for entity, letter in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(letter))
    return x


def _anchor(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_decoded(F.regexp_replace(x, r"<[^>]*>", " ")), r"\s+", " ")), F.lit(""))


# ---------------------------------------------------------------- Markdown


def markdown_qa(docs: DataFrame, *, url: str = "url", markdown: str = "markdown") -> DataFrame:
    """A record for each numbered question heading of a text, up to its first references or annex heading."""
    text = F.coalesce(markdown, F.lit(""))
    stop = F.regexp_instr(text, F.lit(STOP_SECTION))
    body = F.when(stop > 0, F.substring(text, F.lit(1), stop - 1)).otherwise(text)
    numbers, titles = (F.regexp_extract_all("body", F.lit(QA_HEADING), F.lit(i)) for i in (1, 2))
    answers = F.split("body", QA_HEADING, -1)
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\*{1,2}", ""), r"\n{3,}", "\n\n")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    own = docs.select(F.col(url).alias("source_url"), text.alias("text"), F.xxhash64(text).alias("_text"), body.alias("body")).where(F.col("source_url").isNotNull())
    pairs = own.select("source_url", "text", "_text", F.posexplode(F.arrays_zip(numbers.alias("n"), titles.alias("q"), F.slice(answers, 2, F.greatest(F.size(answers) - 1, F.lit(0))).alias("a"))).alias("pos", "x"))
    # what is left when stars and white space at the ends go
    told = pairs.where(F.col("x")["q"].rlike(r"[^\s*]") & F.col("x")["a"].rlike(r"[^\s*]"))
    rows = told.select("source_url", "text", "_text", "pos", F.col("x")["n"].cast("int").alias("seq"), strip(F.replace(F.col("x")["q"], F.lit("*"), F.lit(""))).alias("question"), strip(clean(F.col("x")["a"])).alias("answer"))
    rows = rows.withColumn("qa_id", S.qa_id(F.col("source_url"), F.col("question")))
    records = rows.select("source_url", "_text", "pos", "seq", "qa_id", "question", "answer", F.lit("pdf").alias("source_type"), S.qa_title(F.col("text")).alias("source_title"), S.loose_reference(F.col("text")).alias("reference_number"), S.short_revision(F.col("text")).alias("revision"), S.topic_path_short(F.col("source_url")).alias("topic_path"), S.confidence(F.col("question"), pdf=True).alias("extraction_confidence"))
    return cross_references(records)


def cross_references(records: DataFrame) -> DataFrame:
    """Records with cross_refs and cross_questions: ids and questions that an answer refers to by number, in order; of several with one number the last counts, unknown numbers drop.

    Each text is read once: a record goes along with its number, meets the answers
    that name this by source and number, and what they found meets at its place.
    """
    own = [c for c in records.columns if c not in ("source_url", "pos", "_text")]
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(CROSS_REFERENCE), F.lit(1)), lambda n, at: F.struct(at.alias("at"), n.try_cast("int").alias("number")))
    named = records.withColumn("x", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("seq").alias("number"))), numbers)))
    each = named.select("source_url", "pos", "_text", "x.*", *(F.when(F.col("x.at") < 0, F.col(c)).alias(c) for c in own))
    last = F.max(F.when(F.col("at") < 0, F.struct("pos", "qa_id", "question"))).over(Window.partitionBy("source_url", "number"))
    met = each.withColumn("_last", F.when((F.col("at") >= 0) & F.col("number").isNotNull(), last))
    found = F.array_sort(F.collect_set(F.when(F.col("_last").isNotNull(), F.struct("at", "_last")))).alias("_found")
    # texts that are alike find the same, and come back as often
    one = met.groupBy("source_url", "pos", "_text").agg(*(F.first(c, ignorenulls=True).alias(c) for c in own), F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).cast("int").alias("_n"), found)
    refs, questions = F.col("_found._last.qa_id"), F.col("_found._last.question")
    return one.select("source_url", "pos", *own, refs.alias("cross_refs"), questions.alias("cross_questions"), F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_again")).drop("_again")


def markdown_links(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, tgt_url, link_type, anchor) of Markdown links."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1)), F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(2)))
    return docs.select(key, F.posexplode(zipped).alias("pos", "x")).select(key, "pos", S.without_fragment(F.col("x")["1"]).alias("tgt_url"), F.lit("hyperlink").alias("link_type"), _anchor(F.col("x")["0"]).alias("anchor"))


def reference_mentions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct reference numbers of a text, in order of first mention."""
    return docs.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(S.REFERENCE_STRICT), F.lit(0)))).alias("pos", "tgt_url")).select(key, "pos", "tgt_url", F.lit("reference_number").alias("link_type"), F.lit(None).cast("string").alias("anchor"))


def see_qa_mentions(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentions of other questions as qa:N."""
    zipped = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(SEE_QA), F.lit(i)) for i in (0, 1, 2)))
    number = F.coalesce(F.nullif(F.col("x")["1"], F.lit("")), F.col("x")["2"])
    return docs.select(key, F.posexplode(zipped).alias("pos", "x")).select(key, "pos", F.concat(F.lit("qa:"), number).alias("tgt_url"), F.lit("see_qa").alias("link_type"), _anchor(F.col("x")["0"]).alias("anchor"))


# ---------------------------------------------------------------- HTML, native


def page_anchors(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, tgt_url, link_type, anchor) of all links of a page: absolute, without fragment, no skipped scheme, no link to the page itself."""
    groups = [F.regexp_extract_all(html, F.lit(HREF), F.lit(i)) for i in (1, 2, 3, 4)]
    rows = pages.select(key, F.col(url).alias("base"), F.posexplode(F.arrays_zip(*groups)).alias("pos", "x"))
    href = F.trim(_decoded(F.concat_ws("", *(F.col("x")[str(i)] for i in range(3)))))
    rows = rows.select(key, "base", "pos", href.alias("href"), _anchor(F.col("x")["3"]).alias("anchor")).where((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.col("href").rlike(SKIPPED_SCHEMES))
    rows = rows.withColumn("tgt_url", S.resolved(F.col("href"), F.col("base"))).where(F.col("tgt_url").isNotNull() & (F.col("tgt_url") != S.without_fragment(F.col("base"))))
    return rows.select(key, "pos", "tgt_url", F.lit("hyperlink").alias("link_type"), "anchor")


def all_links(docs: DataFrame, pages: DataFrame | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links and mentions of texts, and of pages with the same key, in one stream."""
    out = markdown_links(docs, key=key, text=text).unionByName(reference_mentions(docs, key=key, text=text)).unionByName(see_qa_mentions(docs, key=key, text=text))
    return out if pages is None else out.unionByName(page_anchors(pages, key=key))


def cross_reference_census(pages: DataFrame, inventory: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Per page the textual mentions of questions, links to question pages, and links that are in the inventory(url)."""
    plain = F.regexp_replace("html", r"<[^>]*>", " ")
    mentions = pages.select(key, F.regexp_count(plain, F.lit(CROSS_REFERENCE)).cast("long").alias("textual"))
    found = page_anchors(pages, key=key).join(inventory.select(F.col("url").alias("tgt_url"), F.lit(1).alias("known")).distinct(), "tgt_url", "left")
    counted = found.groupBy(key).agg(F.count_if(F.lower("tgt_url").rlike("question|q-and-a")).alias("qa_links"), F.count("known").alias("known_links"))
    return mentions.join(counted, key, "left").na.fill(0, ["qa_links", "known_links"])


def concepts_from_rdf(spark, path: str, *, namespaces: tuple[str, ...] = (), stop: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """(label): class labels of an RDF/XML file, or their camel-case names split; four letters and up, no stop words, the longest limit.

    Records end at end tags of classes, so a large file is read in splits; a class
    within another one counts by itself.
    """
    rows = spark.read.option("lineSep", "</owl:Class>").text(path)
    # what follows a start tag, up to the next one or the end tag
    parts = rows.select(F.explode(F.slice(F.split("value", r"<owl:Class\b", -1), 2, 1 << 30)).alias("part"))
    attributes = F.regexp_extract("part", r"^([^>]*)>", 1)
    about = E.unescaped(E.attribute(attributes, "rdf:about"))
    label = E.unescaped(F.regexp_extract("part", r"<rdfs:label\b[^>]*>([^<]*)<", 1))
    rows = parts.select(about.alias("about"), label.alias("text"))
    about, label = F.col("about"), F.col("text")
    if namespaces:
        rows = rows.where(F.coalesce(about.rlike("|".join(namespaces)), F.lit(False)))
    name = F.regexp_replace(F.regexp_extract(about, r"([^/#]+)$", 1), r"(?<=[a-z])(?=[A-Z])", " ")
    found = rows.select(F.lower(F.trim(F.coalesce(F.nullif(F.trim(label), F.lit("")), name))).alias("label")).where((F.length("label") >= 4) & ~F.col("label").isin(*stop or ("",))).distinct()
    return found.orderBy(F.length("label").desc(), "label").limit(limit)


def result_lines(steps: DataFrame, *, key: str = "step_id", output: str = "output") -> DataFrame:
    """Rows of a stored tool output's lines [n] source=... key=value ..."""
    line = F.trim("line")
    pattern = r"^\[(\d+)\] source=(\S+)((?: \w+=\S+)*)\s*$"
    rows = steps.select(key, F.posexplode(F.split(output, "\n")).alias("pos", "line")).where(line.rlike(pattern))
    pairs = F.str_to_map(F.trim(F.regexp_extract(line, pattern, 3)), F.lit(" "), F.lit("="))
    return rows.select(key, "pos", F.regexp_extract(line, pattern, 1).cast("int").alias("n"), F.regexp_extract(line, pattern, 2).alias("source_url"), F.try_element_at(pairs, F.lit("category")).alias("category"), F.try_element_at(pairs, F.lit("score")).try_cast("double").alias("score"))


def note_lines(steps: DataFrame, *, key: str = "step_id", output: str = "output") -> DataFrame:
    """The [note] lines of a stored tool output."""
    return steps.select(key, F.posexplode(F.split(output, "\n")).alias("pos", "line")).where(F.trim("line").rlike(r"^\[(?!\d+\] )[^\]]*\]\s*$")).select(key, "pos", F.trim("line").alias("note"))


# ---------------------------------------------------------------- HTML, by element


def page_elements(pages: DataFrame, *, root_tag: str = "main", root_class: str | None = "main-content-wrapper", audience_class: str = "bg-category", topic_class: str = "bg-topic", skip_tags: Sequence[str] = SKIP_TAGS, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, links, audience, site_topic, questions, main_text) of pages, by their table of elements.

    Links are candidates (href, anchor, context, document_type) in page order, in
    the content root only; without a root there are none, and the main text is that
    of the whole page. A badge class matches by its ending.
    """
    rows = stored(E.tokens(pages, key=key, html=html))
    root_is = (F.col("name") == root_tag) & (E.has_class(F.col("attrs"), root_class) if root_class else F.lit(True))
    root = E.content_root(rows, root_is, key=key)
    found = E.link_candidates(root, skip_tags=skip_tags, skip_classes=SKIP_CLASSES, text_tags=TEXT_TAGS, card_classes=CARD_CLASSES, file_class="bcl-file", title_class="file-title", key=key)
    gathered = lambda df, name, *cols: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias(name))
    links = gathered(found, "links", "href", "anchor", "context", "document_type")
    questions = gathered(E.accordion_items(rows, key=key), "questions", "question", "answer")
    labels = E.badges(root, {"audience": audience_class, "site_topic": topic_class}, key=key)
    text = E.main_texts(E.content_root(rows, root_is, key=key, or_all=True), blocks=LINE_TAGS, skip_tags=skip_tags, key=key)
    out = pages.select(key)
    for part in (links, labels, questions, text):
        out = out.join(part, key, "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.select(key, none("links").alias("links"), "audience", "site_topic", none("questions").alias("questions"), F.coalesce("main_text", F.lit("")).alias("main_text"))


def typed_links(elements: DataFrame, *, domains: tuple[str, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, src_url, tgt_url, anchor, kind, link_context, document_type): per target the link with the richest context, first on ties. elements needs the page's url."""
    rows = elements.select(key, F.col(url).alias("src_url"), F.posexplode("links").alias("pos", "x")).select(key, "src_url", "pos", "x.*").where((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.col("href").rlike(r"(?i)^(mailto|tel|javascript):"))
    rows = rows.withColumn("tgt_url", S.resolved(F.col("href"), F.col("src_url"))).where(F.col("tgt_url").isNotNull() & (F.col("tgt_url") != S.without_fragment(F.col("src_url"))))
    priority = F.coalesce(*(F.when(F.col("context") == c, F.lit(p)) for c, p in CONTEXT_PRIORITY.items()))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "tgt_url").orderBy(priority.desc(), "pos"))).where("_n = 1")
    return first.select(key, "src_url", "tgt_url", F.substring("anchor", 1, 200).alias("anchor"), S.link_kind(F.col("tgt_url"), domains).alias("kind"), F.col("context").alias("link_context"), "document_type")


def accordion_qa(elements: DataFrame, *, url: str = "url", title: Column | None = None) -> DataFrame:
    """A record for each accordion item with a heading and a body."""
    rows = elements.select(F.col(url).alias("source_url"), (F.lit("") if title is None else title).alias("source_title"), F.posexplode("questions").alias("pos", "x")).select("source_url", "source_title", "pos", "x.*")
    return rows.select("source_url", "source_title", "pos", S.qa_id(F.col("source_url"), F.col("question")).alias("qa_id"), "question", "answer", F.lit("html_accordion").alias("source_type"), S.topic_path_short(F.col("source_url")).alias("topic_path"), S.confidence(F.col("question")).alias("extraction_confidence"), F.array().cast("array<string>").alias("cross_refs"))


def parsed_pages(elements: DataFrame, *, least: int = 200) -> DataFrame:
    """Elements with error: empty_input, landing_page_below_min_chars or ''; and the extracted length."""
    size = F.length("main_text")
    return elements.withColumn("extracted_chars", size).withColumn("error", F.when(F.coalesce(size, F.lit(0)) == 0, "empty_input").when(size < least, "landing_page_below_min_chars").otherwise(""))


def inventory(pages: DataFrame, *, in_scope: tuple[str, ...], key: str = "page_id") -> DataFrame:
    """Question pages in scope: accordion count, last revision date, and the rules for a question signal."""
    from ..functions.rules import is_excluded

    accordions = F.regexp_count("html", F.lit(r"""class\s*=\s*["'][^"']*\baccordion-item\b""")).cast("long")
    revision = F.coalesce(F.try_element_at(F.regexp_extract_all(F.regexp_replace("html", r"<[^>]*>", " "), F.lit(r"(?i)Rev\.?\s+([A-Z][a-z]+\s+\d{4}|\w{3}[\s.]\d{4})"), F.lit(1)), F.lit(-1)), F.lit(""))
    signal = F.lower("url").rlike("questions|q-and-a|guidance") | (F.col("q_count") >= 5)
    scope = F.lit(False)
    for s in in_scope:
        scope = scope | F.col("url").contains(s)
    rows = pages.where(~is_excluded(F.col("url"))).select(key, "url", accordions.alias("q_count"), F.trim(revision).alias("last_updated"))
    return rows.where((F.col("q_count") > 0) & signal & scope).withColumn("topic_path", S.topic_path_short(F.col("url")))
