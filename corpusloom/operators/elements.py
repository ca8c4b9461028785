"""Pages as a table of elements, numbered by their start and end tags, and what is read from it by intervals.

A page is a row of tokens: a tag and the text after it. An element begins at the
token of its start tag and stops at that of its end tag; what stands between is
inside, so "in the content root", "in a card" and "text of this link" are
intervals, which windows over a page's tokens sweep once. Everything stays in
Spark's own functions but the decoding of character references.
"""

from __future__ import annotations

import html as html_lib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What is no part of a page's text, and a tag.
DROPPED = r"(?is)<!--.*?-->|<![^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<svg\b.*?</svg\s*>"
TAG = r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>"""
#: Elements without content, those that hold others, and those that end a paragraph.
VOID = tuple("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = tuple("html head body main div section article nav header footer aside form table thead tbody tfoot tr td th ul ol li dl dd dt blockquote figure details fieldset".split())
BLOCKS = (*CONTAINERS, *"p h1 h2 h3 h4 h5 h6 pre hr".split())


@F.pandas_udf(StringType())
def _unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(html_lib.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """text with its character references decoded; only texts that have any leave the JVM."""
    return F.coalesce(_unescaped(F.when(text.contains("&"), text)), text)


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute, empty if there is none; name may be a pattern."""
    groups = [F.regexp_extract(attributes, rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", i) for i in (1, 2, 3)]
    return F.concat(*groups)


def has_class(attributes: Column, pattern: str) -> Column:
    """Whether one of an element's classes is a pattern."""
    return attribute(attributes, "class").rlike(rf"(?:^|\s)(?:{pattern})(?:\s|$)")


def tokens(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, name, attrs, closing, text, post): tokens of pages, each a tag (none at pos 0) with the text that follows it.

    post, of start tags, is the token where the element stops. An end tag belongs
    to the last open start tag of its name. An element without one reaches to the
    end of the nearest container around it that has one, or of the page; a
    paragraph or a part of running text ends at the next block before that. A null
    page is an empty one; a key stands for one page.
    """
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, " ")
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), F.regexp_extract_all("clean", F.lit(TAG), F.lit(0))).alias("tag"), F.split("clean", TAG, -1).alias("text"))
    rows = pages.select(key, clean.alias("clean")).select(key, F.posexplode(zipped).alias("pos", "x"))
    part = lambda i: F.regexp_extract("x.tag", f"^{TAG}$", i)
    rows = rows.select(key, "pos", F.lower(part(2)).alias("name"), part(3).alias("attrs"), (part(1) == "/").alias("closing"), F.col("x.text").alias("text"))
    leaf = F.col("name").isin(*VOID) | F.col("attrs").endswith("/")
    rows = rows.withColumn("side", F.when((F.col("name") == "") | leaf, 0).when(F.col("closing"), -1).otherwise(1))

    def running(*by: str) -> Window:
        return Window.partitionBy(key, *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def following(*by: str) -> Window:
        return Window.partitionBy(key, *by).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)

    # tags of a name at one level open and close in turn
    rows = rows.withColumn("nest", F.sum("side").over(running("name")) - F.when(F.col("side") == 1, 1).otherwise(0))
    same = Window.partitionBy(key, "name", "nest", F.col("side") != 0).orderBy("pos")
    rows = rows.withColumn("next", F.when((F.col("side") == 1) & (F.lead("side").over(same) == -1), F.lead("pos").over(same)))
    rows = rows.withColumn("matched", F.col("next").isNotNull() | ((F.col("side") == -1) & (F.lag("side").over(same) == 1)))
    holds = F.col("matched") & F.col("name").isin(*CONTAINERS)
    rows = rows.withColumn("holds", holds).withColumn("depth", F.sum(F.when(F.col("holds"), F.col("side")).otherwise(0)).over(running()))
    rows = rows.withColumn("within", F.col("depth") + F.when(F.col("holds") & F.col("closing"), 1).otherwise(0))
    around = F.min(F.when(F.col("holds") & F.col("closing"), F.col("pos"))).over(following("within"))
    block = F.min(F.when(F.col("name").isin(*BLOCKS) & ~F.col("closing"), F.col("pos"))).over(following())
    last = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = rows.withColumn("around", F.coalesce(around, last)).withColumn("block", block)
    open_end = F.when(F.col("name").isin(*CONTAINERS), F.col("around")).otherwise(F.least("around", "block"))
    post = F.when(F.col("side") == 1, F.coalesce("next", open_end)).when((F.col("name") != "") & ~F.col("closing"), F.col("pos"))
    return rows.select(key, "pos", "name", "attrs", "closing", "text", post.cast("int").alias("post"))


def swept(rows: DataFrame, families: Mapping[str, Column], *, key: str = "page_id") -> DataFrame:
    """tokens with, for each family of elements (a condition on start tags), in_NAME: how many of them a token stands in, its own start counted, and at_NAME: where the outermost one began."""
    begin = {n: F.when(F.col("post").isNotNull() & (F.col("post") > F.col("pos")), F.coalesce(c, F.lit(False))).otherwise(False) for n, c in families.items()}
    marked = rows.select("*", *(c.cast("int").alias(f"_is_{n}") for n, c in begin.items()))
    some = " or ".join(f"_is_{n} = 1" for n in families)
    ends = marked.where(some).groupBy(key, F.col("post").alias("pos")).agg(*(F.sum(f"_is_{n}").alias(f"_end_{n}") for n in families))
    joined = marked.join(ends, [key, "pos"], "left")
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for n in families:
        joined = joined.withColumn(f"in_{n}", F.sum(F.col(f"_is_{n}") - F.coalesce(F.col(f"_end_{n}"), F.lit(0))).over(run))
    for n in families:
        at = F.last(F.when((F.col(f"_is_{n}") == 1) & (F.col(f"in_{n}") == 1), F.col("pos")), ignorenulls=True).over(run)
        joined = joined.withColumn(f"at_{n}", F.when(F.col(f"in_{n}") > 0, at))
    return joined.drop(*(f"_{x}_{n}" for n in families for x in ("is", "end")))


def texts(rows: DataFrame, at: str, *, key: str = "page_id", sep: str = " ") -> DataFrame:
    """(key, at, text): the words under each element that swept rows name in the column at."""
    plain = F.trim(F.regexp_replace(unescaped(F.col("text")), r"\s+", " "))
    told = rows.where(F.col(at).isNotNull()).select(key, at, "pos", plain.alias("t")).where("t <> ''")
    return told.groupBy(key, at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), sep).alias("text"))


def content_root(rows: DataFrame, condition: Column, *, key: str = "page_id", or_all: bool = False) -> DataFrame:
    """tokens inside a page's first element that meets a condition; pages without one have none, or all if or_all."""
    first = rows.where((F.col("post") > F.col("pos")) & condition).groupBy(key).agg(F.min(F.struct("pos", "post")).alias("_root"))
    inside = (F.col("pos") >= F.col("_root.pos")) & (F.col("pos") < F.col("_root.post"))
    return rows.join(first, key, "left").where(F.coalesce(inside, F.lit(or_all))).drop("_root")


def link_candidates(root: DataFrame, *, skip_tags: Sequence[str], skip_classes: Sequence[str], text_tags: Sequence[str], card_classes: Sequence[str], file_class: str, title_class: str, key: str = "page_id") -> DataFrame:
    """(key, pos, href, anchor, context, document_type) of the links among some tokens, outside what is skipped.

    The context is that of a file, else of a card or listing, else running text. A
    link in a file has its title and type.
    """
    attrs = F.col("attrs")
    name = F.col("name")
    families = {
        "link": (name == "a") & (attribute(attrs, "href") != ""),
        "skip": name.isin(*skip_tags) | has_class(attrs, "|".join(skip_classes)),
        "file": has_class(attrs, file_class),
        "card": has_class(attrs, "|".join(card_classes)),
        "title": has_class(attrs, title_class),
        "flow": name.isin(*text_tags),
    }
    rows = swept(root, families, key=key)
    context = F.when(F.col("in_file") > 0, "file_component").when(F.col("in_card") > 0, "card_or_listing").when(F.col("in_flow") > 0, "inline").otherwise("other")
    links = rows.where((F.col("pos") == F.col("at_link")) & (F.col("in_skip") == 0)).select(key, "pos", attribute(attrs, "href").alias("href"), context.alias("context"), "at_file")
    own = texts(rows, "at_link", key=key).select(key, F.col("at_link").alias("pos"), F.col("text").alias("own"))
    titles = texts(rows.withColumn("at_title", F.when(F.col("in_title") > 0, F.col("at_file"))), "at_title", key=key).select(key, F.col("at_title").alias("at_file"), F.col("text").alias("title"))
    kinds = rows.where(F.col("pos") == F.col("at_file")).select(key, "at_file", F.nullif(attribute(attrs, r"[\w-]*-document-type"), F.lit("")).alias("document_type"))
    joined = links.join(own, [key, "pos"], "left").join(titles, [key, "at_file"], "left").join(kinds, [key, "at_file"], "left")
    return joined.select(key, "pos", unescaped(F.col("href")).alias("href"), F.coalesce("title", "own", F.lit("")).alias("anchor"), "context", "document_type")


def badges(root: DataFrame, classes: Mapping[str, str], *, label_class: str = "label", key: str = "page_id") -> DataFrame:
    """X11: (key, a column for each ending of a class): the first span of that class among some tokens, its label if it has one; null for an empty text."""
    out = None
    for column, ending in classes.items():
        family = (F.col("name") == "span") & has_class(F.col("attrs"), rf"\S*{ending}")
        rows = swept(root, {"badge": family, "label": (F.col("name") == "span") & has_class(F.col("attrs"), label_class)}, key=key)
        first = rows.where(F.col("at_badge").isNotNull()).groupBy(key).agg(F.min("at_badge").alias("_first"))
        own = rows.join(first, key).where(F.col("at_badge") == F.col("_first"))
        label = own.where("in_label > 0").groupBy(key).agg(F.min("at_label").alias("_label"))
        chosen = own.join(label, key, "left").where(F.col("_label").isNull() | (F.col("at_label") == F.col("_label")))
        one = texts(chosen, "at_badge", key=key).select(key, F.col("text").alias(column))
        out = one if out is None else out.join(one, key, "full")
    return out


def accordion_items(rows: DataFrame, *, item: str = "accordion-item", header: str = "accordion-header", body: str = "accordion-body", key: str = "page_id") -> DataFrame:
    """(key, pos, question, answer) of accordion items with a heading, its button if it has one, and a body."""
    attrs = F.col("attrs")
    found = swept(rows, {"item": has_class(attrs, item), "header": has_class(attrs, header), "body": has_class(attrs, body), "button": F.col("name") == "button"}, key=key)
    inside = found.where("in_item > 0")

    def first(name: str, part: DataFrame) -> DataFrame:
        """The text of the first element of a family in each item."""
        at = part.where(f"in_{name} > 0").groupBy(key, "at_item").agg(F.min(f"at_{name}").alias("_first"))
        own = part.join(at, [key, "at_item"]).where(F.col(f"at_{name}") == F.col("_first")).drop("_first")
        return texts(own, "at_item", key=key)

    heading = first("header", inside).withColumnRenamed("text", "heading")
    button = first("button", inside.where("in_header > 0")).withColumnRenamed("text", "button")
    answer = first("body", inside).withColumnRenamed("text", "answer")
    whole = heading.join(button, [key, "at_item"], "left").join(answer, [key, "at_item"])
    return whole.select(key, F.col("at_item").alias("pos"), F.coalesce("button", "heading").alias("question"), "answer")


def main_texts(root: DataFrame, *, blocks: Sequence[str], skip_tags: Sequence[str], key: str = "page_id") -> DataFrame:
    """(key, main_text): the running text of some tokens, a line for each block, in page order; white space is collapsed.

    A line ends at every start and end of a block. Text outside any block counts as
    a line of its own. Skipped elements have none.
    """
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = swept(root, {"skip": F.col("name").isin(*skip_tags)}, key=key).withColumn("line", F.sum(F.col("name").isin(*blocks).cast("int")).over(run))
    lines = texts(rows.where("in_skip = 0"), "line", key=key)
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("main_text"))
