"""Scalar functions over columns: ids, addresses, header metadata, similarity, judgements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of header metadata.
REFERENCE_STRICT = r"\bEMA/[A-Z0-9][A-Z0-9/\-]*?/\d{2,7}/\d{4}\b"
REFERENCE_LOOSE = r"(?i)EMA/[A-Z0-9]+/[A-Z0-9/]*/\d{4}(?:\s+Rev\.?\s*\d+)?"
COMMITTEES = ("CHMP", "PRAC", "CVMP", "COMP", "PDCO", "CAT")
REVISION_HEADER = r"(?i)\b(?:Rev(?:ision)?\.?\s*)(\d+(?:\.\d+)?)\b"
REVISION_SHORT = r"(?i)Rev\.?\s*(\d+)"
DAY_MONTH_YEAR = r"\b(\d{1,2})\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{4})\b"
QUESTION_START = r"(?i)^(what|when|where|which|who|why|how|should|can|could|does|do|is|are|may|will|must|has|have|would|shall|need|did|was|were|am)\b"
#: Fixed value: white space as Unicode has it, and the four separators that count as such beside it.
WHITE = r"(?U)[\s\x1c-\x1f]+"
FILE_ENDINGS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "csv")


def _nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


# ---------------------------------------------------------------- ids and texts


def doc_id(url: Column) -> Column:
    """A document's id."""
    return F.sha2(url, 256)


def normalised(text: Column) -> Column:
    """Lower case, Unicode's white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE, " "))


def folded(text: Column) -> Column:
    """text for comparison without regard to case: lower case, sharp s as ss, one lower sigma, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss")), WHITE, " "))


def unfolded_place(text: Column, at: Column) -> Column:
    """The place in text, from zero, of the character that made the one at place at of folded(text)."""
    lead = F.length(F.regexp_extract(text, "^" + WHITE.replace("(?U)", "(?U:") + ")", 0))
    rest = F.substring(text, lead + 1, F.length(text))
    before = F.substring(folded(text), F.lit(1), at)
    n_words = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    words, gaps = F.split(rest, WHITE), F.regexp_extract_all(rest, F.lit(WHITE), F.lit(0))
    total = lambda xs: F.aggregate(F.slice(xs, F.lit(1), n_words), F.lit(0), lambda n, x: n + F.length(x))
    word, within = F.get(words, n_words), F.length(F.substring_index(before, " ", -1))
    # where a letter became several, as many letters as don't reach the place
    letters = F.size(F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.length(folded(F.substring(word, F.lit(1), i))) <= within))
    return lead + total(words) + total(gaps) + F.when(F.length(folded(word)) == F.length(word), within).otherwise(letters)


def dedup_key(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def qa_id(url: Column, question: Column) -> Column:
    """Id of a question on a page."""
    return F.substring(F.sha2(F.concat(url, F.lit("\0"), normalised(question)), 256), 1, 16)


def chunk_id(doc: Column, number: Column) -> Column:
    """Id of the number-th chunk of a document."""
    return F.substring(F.sha2(F.concat(doc, F.lit("|"), number.cast("string")), 256), 1, 32)


def quote(text: Column, length: int = 240) -> Column:
    """One line of at most length characters, with an ellipsis where it was cut."""
    line = F.trim(F.regexp_replace(text, WHITE, " "))
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length), F.lit("…"))).otherwise(line)


# ---------------------------------------------------------------- addresses


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def _without_file(parts: Column) -> Column:
    return F.when(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).contains("."), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def source_type_of_url(url: Column) -> Column:
    """Pdf, html or unknown by the address' last segment."""
    path = url_path(url)
    last = F.try_element_at(F.split(path, "/"), F.lit(-1))
    ending = F.lower(F.try_element_at(F.split(last, r"\."), F.lit(-1)))
    return F.when(path == "", "unknown").when(~last.contains("."), "html").when(ending == "pdf", "pdf").when(ending.isin("html", "htm"), "html").otherwise("unknown")


def source_type(content_type: Column, url: Column) -> Column:
    """P5: by content type, else by address."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(ct.contains("pdf"), "pdf").when(ct.contains("html"), "html").otherwise(source_type_of_url(url))


def topic_path(url: Column) -> Column:
    """The directory of an address with slashes at both ends; null without a path."""
    parts = _without_file(_segments(url))
    return F.when(url_path(url) != "", F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"))).otherwise("/"))


def topic_path_short(url: Column, depth: int = 5) -> Column:
    """Directory without language segments and file, cut to depth segments, no slash at the end."""
    parts = _without_file(F.filter(_segments(url), lambda s: s != "en"))
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, depth), "/"))


def site_segments(topic: Column, url: Column) -> Column:
    """Segments of the topic path, else of the address, without a leading language."""
    path = F.coalesce(_nonempty(topic), url_path(url), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.get(parts, F.lit(0)) == "en", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def resolved(href: Column, base: Column) -> Column:
    """Href against a base address, without its fragment; null unless http(s)."""
    href = F.trim(href)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    path = url_path(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, _dotless(href)))
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("#") | (href == ""), base)
        .otherwise(F.concat(root, _dotless(F.concat(folder, href))))
    )
    out = without_fragment(joined)
    return F.when(out.rlike(r"^https?://[^/?#]+"), out)


def _dotless(path: Column) -> Column:
    """A path without its . and .. segments; the query string stays."""
    query = F.regexp_extract(path, r"([?#].*)$", 1)
    plain = F.regexp_replace(path, r"[?#].*$", "")
    parts = F.split(plain, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(plain.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(plain.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), tail, query)).otherwise(path)


def link_kind(url: Column, domains: tuple[str, ...]) -> Column:
    """File by ending, page by domain, else external."""
    path, host = F.lower(url_path(url)), url_host(url)
    own = F.lit(False)
    for d in domains:
        own = own | (host == d) | host.endswith("." + d)
    return F.when(path.rlike(r"\.(" + "|".join(FILE_ENDINGS) + ")$"), "file").when(own, "page").otherwise("external")


def hub_key(url: Column) -> Column:
    """Slug of an address' last segment, with a letter before a leading digit."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.try_element_at(_without_file(_segments(url)), F.lit(-1)), F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(slug == "", "hub").when(slug.rlike(r"^\d"), F.concat(F.lit("h_"), slug)).otherwise(slug)


# ---------------------------------------------------------------- header metadata


def markdown_title(text: Column) -> Column:
    """The first heading of level one without stars; null without one."""
    return _nonempty(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1), r"^\*+|\*+$", "")))


def title_or_tail(text: Column, url: Column) -> Column:
    return F.coalesce(markdown_title(text), _nonempty(F.try_element_at(_segments(url), F.lit(-1))), url)


def qa_title(text: Column) -> Column:
    """Markdown title without stars, cut to 200."""
    return F.substring(F.replace(F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1)), F.lit("*"), F.lit("")), 1, 200)


def html_title(html: Column) -> Column:
    """First h1, else title before the first bar, cut to 200, without markup."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))
    h1 = plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    title = F.trim(F.split_part(plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit("|"), F.lit(1)))
    return F.substring(F.when(html.rlike(r"(?i)<h1\b"), h1).otherwise(title), 1, 200)


def header_metadata(text: Column) -> Column:
    """P10: struct of reference_number, committee, revision and last_updated, from a text's head."""
    head = F.substring(text, 1, 2048)
    reference = _nonempty(F.regexp_extract(head, REFERENCE_STRICT, 0))
    committee = F.regexp_extract(reference, r"^EMA/([A-Z]+)/", 1)
    early = F.substring(text, 1, 1024)
    day, month, year = (F.regexp_extract(early, DAY_MONTH_YEAR, i) for i in (1, 2, 3))
    date = F.when(day != "", F.to_date(F.try_to_timestamp(F.concat_ws(" ", day, month, year), F.lit("d MMMM yyyy"))))
    return F.struct(reference.alias("reference_number"), F.when(committee.isin(*COMMITTEES), committee).alias("committee"), _nonempty(F.regexp_extract(head, REVISION_HEADER, 1)).alias("revision"), date.alias("last_updated"))


def loose_reference(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.substring(text, 1, 2000), REFERENCE_LOOSE, 0))


def short_revision(text: Column) -> Column:
    number = F.regexp_extract(F.substring(text, 1, 2000), REVISION_SHORT, 1)
    return F.when(number != "", F.concat(F.lit("Rev."), number)).otherwise("")


def member_revision(stamped: Column, title: Column) -> Column:
    """The stamped revision, else the title's."""
    return F.coalesce(_nonempty(stamped), _nonempty(F.regexp_extract(title, REVISION_SHORT, 1)))


def iso_date(value: Column) -> Column:
    """A date in one of three forms, in UTC; null for any other."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))


def confidence(heading: Column, *, pdf: bool = False) -> Column:
    """High for a question, else medium; of a PDF's headings only those with a question mark are questions."""
    asked = heading.endswith("?")
    return F.when(asked if pdf else asked | F.trim(F.regexp_replace(heading, r"\?+$", "")).rlike(QUESTION_START), "high").otherwise("medium")


# ---------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """A vector scaled to length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.coalesce(x.cast("double") / F.nullif(norm, F.lit(0.0)), x.cast("double")))


def similarity(a: Column, b: Column, digits: int = 6) -> Column:
    """P20: cosine of unit vectors on a scale from 0 to 1."""
    return F.round((1 + dot(a, b)) / 2, digits)


# ---------------------------------------------------------------- judgements and records


def rating(value: Column, scale: Column) -> Column:
    """A rating from 1 to 5. scale says how value is meant: bool, unit (0 to 1) or stars."""
    number = F.expr("try_cast(1 as double)") * value.try_cast("double")
    return F.when(scale == "bool", F.when(value.try_cast("boolean"), 5.0).otherwise(1.0)).when(scale == "unit", number * 5).otherwise(number)


def judge_json(raw: Column) -> Column:
    """The outermost object of a judge's answer, without code fences."""
    return F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)


def grade(raw: Column) -> Column:
    """Struct per_doc(index, score), missing_facts and parsed of a grader's answer; empty and not parsed on failure."""
    schema = "per_doc array<struct<index:int,score:int>>, missing_facts array<string>"
    found = F.from_json(_nonempty(judge_json(raw)), schema)
    return F.struct(F.coalesce(found["per_doc"], F.array().cast("array<struct<index:int,score:int>>")).alias("per_doc"), F.coalesce(found["missing_facts"], F.array().cast("array<string>")).alias("missing_facts"), found["per_doc"].isNotNull().alias("parsed"))


def judge_score(raw: Column) -> Column:
    """The score of a judge's answer, -1 if it has none."""
    return F.coalesce(F.get_json_object(judge_json(raw), "$.score").try_cast("double"), F.lit(-1.0))


def sufficient(graded: Column) -> Column:
    """Some document answers in full and nothing is missing."""
    return F.exists(graded["per_doc"], lambda x: x["score"] == 2) & (F.size(graded["missing_facts"]) == 0)


def grade_key(graded: Column) -> Column:
    """Orders grades by best score, then by fewest missing facts."""
    best = F.coalesce(F.array_max(F.transform(graded["per_doc"], lambda x: x["score"])), F.lit(-1))
    return F.struct(best.alias("best"), (-F.size(graded["missing_facts"])).alias("neg_missing"))


def without_nulls(properties: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(properties, lambda _, v: v.isNotNull())


def substance(query: Column, payload: Column, limit: int = 15) -> Column:
    """Name, registry number, synonyms, weight and a found flag of a substance payload."""
    schema = "properties struct<PropertyTable:struct<Properties:array<struct<Title:string,IUPACName:string,MolecularWeight:string>>>>, synonyms struct<InformationList:struct<Information:array<struct<Synonym:array<string>>>>>"
    found = F.from_json(payload, schema)
    first = F.get(found["properties"]["PropertyTable"]["Properties"], F.lit(0))
    names = F.coalesce(F.get(found["synonyms"]["InformationList"]["Information"], F.lit(0))["Synonym"], F.array().cast("array<string>"))
    number = F.get(F.filter(names, lambda s: s.rlike(r"^\d{2,7}-\d{2}-\d$")), F.lit(0))
    return F.struct(query.alias("query"), F.coalesce(first["Title"], first["IUPACName"]).alias("name"), number.alias("cas"), F.slice(names, 1, limit).alias("synonyms"), first["MolecularWeight"].try_cast("double").alias("molecular_weight"), first.isNotNull().alias("found"))


def concepts_in(text: Column, concepts: list[str]) -> Column:
    """The concepts that stand in a text, in their own order."""
    return F.filter(F.array(*(F.lit(c) for c in concepts)), lambda c: F.contains(F.lower(text), F.lower(c)))


def shape_metrics(answer: Column) -> Column:
    """Characters, citations and claims of an answer, and its confidence."""
    return F.struct(F.length(answer["answer"]).alias("chars"), F.size(answer["citations"]).alias("citations"), F.size(answer["claims"]).alias("claims"), answer["confidence"].alias("confidence"))


def marked_text(text: Column, spans: Column) -> Column:
    """Text with [n] markers after each span(start, end, ns), put in from the end backwards."""
    order = F.array_sort(spans, lambda a, b: F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))

    def put(out: Column, s: Column) -> Column:
        marks = F.array_join(F.transform(F.array_sort(F.array_distinct(s["ns"])), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
        gap = F.when((s["end"] < F.length(out)) & F.substring(out, s["end"], F.lit(1)).rlike("^" + WHITE.replace("(?U)", "(?U:") + ")"), "").otherwise(" ")
        return F.when(F.size(s["ns"]) == 0, out).otherwise(F.concat(F.substring(out, F.lit(1), s["end"]), gap, marks, F.substring(out, s["end"] + 1, F.length(out))))

    return F.aggregate(order, text, put)


def member_line(title: Column, url: Column, reference: Column, revision: Column) -> Column:
    """One line for a member of a topic."""
    return F.concat_ws(" · ", F.concat(F.lit("- "), F.coalesce(_nonempty(title), url)), _nonempty(reference), F.when(revision.isNotNull(), F.concat(F.lit("Rev. "), revision)), url)


def numbered_line(n: Column, url: Column, category: Column, score: Column, text: Column) -> Column:
    """One passage of a numbered context block."""
    return F.concat(F.format_string("[%d] source=%s category=%s score=%.3f\n", n, url, category, score), text)
