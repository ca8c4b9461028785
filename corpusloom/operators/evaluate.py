"""Evaluation data work: benchmark checks, score roll-ups, citations, claim spans, stored traces."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import folded, quote, rating, unfolded_place
from ..sources.shared import stored

#: Least similarity of a claim to its span and least length of a claim, what a benchmark item needs, and how many items of each type there are to be.
FUZZY, LEAST_CLAIM = 0.85, 8
REQUIRED_FIELDS = ("bench_id", "question", "paraphrases", "type", "gold_answer", "gold_qa_ids", "gold_sources", "topic_path")
TYPE_TARGETS = {"T1": 20, "T2": 10, "T3": 10}
LEAST_T4 = 5


# ---------------------------------------------------------------- benchmark


def limited_benchmark(items: DataFrame, *, types: Sequence[str] | None = None, limit: int | None = None, key: str = "bench_id") -> DataFrame:
    """Items of some types, at most limit of each type by id; an empty result is an error."""
    out = items.where(F.col("type").isin(*types)) if types else items
    if limit:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy(key))).where(F.col("_n") <= limit).drop("_n")
    if out.limit(1).count() == 0:
        raise ValueError("no benchmark items of these types")
    return out


def benchmark_violations(items: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(rule, bench_id, detail) for each broken rule of a benchmark."""
    bid = F.coalesce("bench_id", F.lit("<missing>"))

    def broken(rule: str, rows: DataFrame, detail: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), bid.alias("bench_id"), detail.cast("string").alias("detail"))

    kinds = dict(items.dtypes)
    parts = []
    for f in REQUIRED_FIELDS:
        if f not in kinds:
            parts.append(broken("required_field", items, F.lit(f)))
            continue
        empty = F.col(f).isNull() | ((F.size(f) == 0) if kinds[f].startswith(("array", "map")) else (F.col(f).cast("string") == ""))
        parts.append(broken("required_field", items.where(empty), F.lit(f)))
    parts.append(broken("id_format", items.where(~F.coalesce(F.col("bench_id").rlike(r"^T[1-4]-\d{3}$"), F.lit(False))), F.col("bench_id")))
    repeated = items.groupBy("bench_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts.append(broken("duplicate_id", repeated, F.col("n")))
    parts.append(broken("type", items.where(~F.coalesce(F.col("type").isin("T1", "T2", "T3", "T4"), F.lit(False))), F.col("type")))
    golds = items.select("bench_id", F.explode("gold_qa_ids").alias("qa_id"))
    parts.append(broken("gold_id_empty", golds.where("qa_id is null or qa_id = ''"), F.lit("")))
    if corpus is not None:
        parts.append(broken("gold_id_unknown", golds.join(corpus.select("qa_id").distinct(), "qa_id", "left_anti"), F.col("qa_id")))
    sources = items.select("bench_id", "type", F.explode("gold_sources").alias("s"))
    parts.append(broken("source_url", sources.where("s.url is null"), F.lit("")))
    parts.append(broken("source_page", sources.where("s.page is null"), F.lit("")))
    counts = items.agg(*(F.count_if(F.col("type") == t).alias(t) for t in (*TYPE_TARGETS, "T4")))
    for t, n in TYPE_TARGETS.items():
        parts.append(broken("type_target", counts.where(F.col(t) != n).withColumn("bench_id", F.lit(t)), F.col(t)))
    parts.append(broken("type_target", counts.where(F.col("T4") < LEAST_T4).withColumn("bench_id", F.lit("T4")), F.col("T4")))
    parts.append(broken("t1_one_id", items.where((F.col("type") == "T1") & (F.size("gold_qa_ids") != 1)), F.size("gold_qa_ids")))
    parts.append(broken("t4_two_sources", items.where((F.col("type") == "T4") & (F.size(F.array_distinct(F.transform("gold_sources", lambda s: s["url"]))) < 2)), F.lit("")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- scores


def mean_scores(scores: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Mean per judge over the values that read as numbers."""
    return scores.groupBy(*by).agg(F.round(F.avg(F.col("value").try_cast("double")), 6).alias("mean"), F.count(F.col("value").try_cast("double")).alias("n"))


def by_type(rows: DataFrame) -> DataFrame:
    """Rows with type_order, T1 to T4 in order and unknown types last."""
    order = F.array_position(F.array(*(F.lit(t) for t in ("T1", "T2", "T3", "T4"))), F.col("type"))
    return rows.withColumn("type_order", F.when(order > 0, order).otherwise(5).cast("int"))


def score_floor(rows: DataFrame, least: float) -> DataFrame:
    """rows with a score of least or more; a row without a score is an error."""
    return rows.where(F.when(F.col("score").isNull(), F.raise_error(F.lit("a row without a score"))).otherwise(F.col("score") >= least))


#: Judges by name: functions of the columns question and prediction that give a score from 0 to 1; more can be put in.
JUDGES: dict[str, Callable[[Column, Column], Column]] = {"exact": lambda question, prediction: (folded(question) == folded(prediction)).cast("double"), "overlap": lambda question, prediction: _overlap(question, prediction)}


def _overlap(question: Column, prediction: Column) -> Column:
    asked, said = (F.array_distinct(F.split(folded(x), " ")) for x in (question, prediction))
    return F.round(F.size(F.array_intersect(asked, said)) / F.size(asked), 6)


def scored_by(rows: DataFrame, judge: str | Callable[[Column, Column], Column], *, question: str = "question", prediction: str = "prediction") -> DataFrame:
    """D3: rows with score, from a named judge or any function of the two columns (a pandas UDF, say)."""
    return rows.withColumn("score", (JUDGES[judge] if isinstance(judge, str) else judge)(F.col(question), F.col(prediction)))


def review_verdict(scores: DataFrame, threshold: float, *, by: str = "run_id") -> DataFrame:
    """Whether all usable scores (above zero) of a run reach the threshold; a run without any fails."""
    usable = F.when(F.col("score") > 0, F.col("score") >= threshold)
    return scores.groupBy(by).agg(F.coalesce(F.bool_and(usable), F.lit(False)).alias("passed"), F.count(usable).alias("usable"))


def comparison(scores: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Mean score per recipe and type, a column per judge."""
    return scores.groupBy("recipe", "type").pivot("judge", list(judges)).agg(F.round(F.avg("score"), 6))


def lowest(scores: DataFrame, n: int, *, by: str = "run_id", key: str = "item_id") -> DataFrame:
    """The n lowest scores per run, missing ones first."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_first("score"), key))).where(F.col("place") <= n)


def roll_up(predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score per question type and judge over predictions(item_id, type) and scores(item_id, name, value)."""
    return by_type(mean_scores(predictions.select("item_id", "type").join(scores, "item_id"), ("type", "name")))


def feedback_counts(records: DataFrame) -> DataFrame:
    """Citation verdicts by category and preferred category."""
    return records.groupBy("category", "preferred_category", "verdict").agg(F.count(F.lit(1)).alias("n"))


def best_cycle(cycles: DataFrame, *, by: str = "query_id") -> DataFrame:
    """The best row of cycles(cycle, best, missing) per query: highest score, fewest missing facts, later cycle on ties."""
    order = Window.partitionBy(by).orderBy(F.desc("best"), F.asc("missing"), F.desc("cycle"))
    return cycles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cluster_report(sources: DataFrame) -> DataFrame:
    """Pages, PDFs and estimated questions per cluster of sources(cluster, type, q_count, textual, known_links)."""
    out = sources.groupBy("cluster").agg(F.count_if(F.col("type") == "html").alias("pages"), F.count_if(F.col("type") == "pdf").alias("pdfs"), F.coalesce(F.sum("q_count"), F.lit(0)).alias("questions"), F.sum("textual").alias("_t"), F.sum("known_links").alias("_k"))
    return out.select("cluster", "pages", "pdfs", "questions", (F.col("pages") + F.col("pdfs") < 5).alias("thin"), F.round(100 * F.col("_k") / F.nullif(F.col("_t") + F.col("_k"), F.lit(0)), 1).alias("completeness"))


def inventory_summary(sources: DataFrame, least: int = 500) -> DataFrame:
    """A10: counts of an inventory and whether there are enough questions to go on."""
    return sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("type") == "html").alias("pages"), F.count_if(F.col("type") == "pdf").alias("pdfs"), F.coalesce(F.sum("q_count"), F.lit(0)).alias("questions")).withColumn("verdict", F.when(F.col("questions") >= least, "go").otherwise("no-go"))


# ---------------------------------------------------------------- citations


def citations(nodes: DataFrame, *, by: str = "run_id") -> DataFrame:
    """One citation per chunk of nodes(chunk_id, source_url, score, pos, text): best score, strongest first, missing scores last, first seen on ties."""
    key = F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), F.col("source_url"))
    one = nodes.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_key").orderBy(F.desc_nulls_last("score"), "pos"))).where("_n = 1").drop("_n", "_key")
    return one.withColumn("quote", quote(F.col("text"))).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("score"), "pos")))


def claim_citations(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """The citation of each claim reference(run_id, claim_no, chunk_id, source_url): by chunk id, else by address; the first of several, each once per claim."""
    first = lambda c: cited.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy("run_id", c).agg(F.min("place").alias(f"_by_{c}"))
    joined = claims.join(first("chunk_id"), ["run_id", "chunk_id"], "left").join(first("source_url"), ["run_id", "source_url"], "left")
    return joined.select("run_id", "claim_no", F.coalesce("_by_chunk_id", "_by_source_url").alias("place")).where("place is not null").distinct()


def enriched_citations(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Citations without a document id take id, chunk and score of the strongest node of their address."""
    strongest = nodes.groupBy("run_id", "source_url").agg(F.max_by(F.struct("doc_id", "chunk_id", "score"), F.struct(F.coalesce("score", F.lit(-1.0)), (-F.col("pos")).alias("p"))).alias("_s"))
    joined = cited.join(strongest, ["run_id", "source_url"], "left")
    bare = F.coalesce(F.col("doc_id"), F.lit("")) == ""
    return joined.select(*(F.when(bare, F.coalesce(F.col("_s")[c], F.col(c))).otherwise(F.col(c)).alias(c) if c in ("doc_id", "chunk_id", "score") else F.col(c) for c in cited.columns))


def reference_numbers(spans: DataFrame, cited: DataFrame) -> DataFrame:
    """Numbers of citations by first appearance in the answer, those never cited after them in their own order."""
    first = spans.groupBy("run_id", "place").agg(F.min("start").alias("_first"))
    order = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("_first"), "place")
    return cited.join(first, ["run_id", "place"], "left").withColumn("n", F.row_number().over(order)).drop("_first")


def evolution(nodes: DataFrame) -> DataFrame:
    """Per run and document of nodes(run_id, doc_id, seq, origin, chunk_id, n): first step, origins, distinct chunks, first reference number."""
    return nodes.groupBy("run_id", "doc_id").agg(F.min("seq").alias("first_step"), F.array_sort(F.collect_set("origin")).alias("origins"), F.count_distinct("chunk_id").alias("chunks"), F.min_by("n", F.when(F.col("n").isNotNull(), F.col("seq"))).alias("n"))


# ---------------------------------------------------------------- claim spans


def exact_spans(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """(run_id, claim_no, start, stop): where claims of LEAST_CLAIM characters and up stand in the answer, in places of the answer as it is; null for the others.

    Case and runs of white space make no difference.
    """
    a = answers.select("run_id", F.col("answer").alias("_raw"), folded(F.col("answer")).alias("_a"))
    c = claims.select("run_id", "claim_no", folded(F.col("claim")).alias("_c"))
    at = F.when(F.length("_c") >= LEAST_CLAIM, F.nullif(F.instr("_a", F.col("_c")), F.lit(0))) - 1
    found = c.join(a, "run_id").withColumn("_at", at)
    last = F.col("_at") + F.length("_c") - 1
    place = lambda x: F.when(F.col("_at").isNotNull(), unfolded_place(F.col("_raw"), x))
    return found.select("run_id", "claim_no", place(F.col("_at")).cast("long").alias("start"), (place(last) + 1).cast("long").alias("stop"))


def fold_with_places(text: str) -> tuple[str, list[int]]:
    """text as folded has it, and for each of its characters the place in text that it came from."""
    out, places = [], []
    for at, letter in enumerate(text):
        if letter.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                places.append(at)
            elif out:
                places[-1] = at
        else:
            low = letter.casefold()
            out += low
            places += [at] * len(low)
    while out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def nearest_window(answer: str, claim: str, threshold: float = FUZZY) -> tuple[int, int] | None:
    """(start, stop) of the window of claim's length, of those that begin at each fifth of it, that is most similar to claim by threshold or more; the first of several.

    How many characters a window shares with the claim, whatever their order,
    bounds the similarity; it is counted for all windows at once, and only those
    whose bound can win are compared.
    """
    width = len(claim)
    if len(answer) <= width:
        return (0, len(answer)) if answer and SequenceMatcher(None, claim, answer).ratio() >= threshold else None
    asked, code = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (claim, answer))
    starts = np.arange(0, len(answer) - width + 1, max(1, width // 5))
    shared = np.zeros(len(starts), np.int64)
    for letter, wanted in zip(*np.unique(asked, return_counts=True), strict=True):
        count = np.concatenate([[0], np.cumsum(code == letter)])
        shared += np.minimum(count[starts + width] - count[starts], wanted)
    best, found = 0.0, None
    matcher = SequenceMatcher(None, claim, "")
    for at, bound in zip(starts.tolist(), (shared / width).tolist(), strict=True):
        if bound >= threshold and bound > best:
            matcher.set_seq2(answer[at : at + width])
            if (ratio := matcher.ratio()) > best:
                best, found = ratio, (at, at + width)
    return found if best >= threshold else None


def claim_spans(answers: DataFrame, claims: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """Exact spans, and for claims not found the most similar window of the answer, by threshold or more; start is null for unmatched claims. Places are those of the answer as it is."""
    exact = exact_spans(answers, claims)
    missed = exact.where("start is null").select("run_id", "claim_no").join(claims, ["run_id", "claim_no"]).join(answers, "run_id")
    rows = missed.select("run_id", "claim_no", "claim", "answer")

    def fuzzy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # an answer has several claims
        fold = lru_cache(256)(fold_with_places)
        for pdf in batches:
            out = []
            for run, no, claim, answer in pdf.itertuples(index=False):
                text, places = fold(answer or "")
                wanted = fold_with_places(claim or "")[0]
                span = nearest_window(text, wanted, threshold) if len(wanted) >= LEAST_CLAIM else None
                whole = len(answer or "") if len(text) <= len(wanted) else 0
                out.append((run, no, *((places[span[0]], whole or places[span[1] - 1] + 1) if span else (None, None))))
            yield pd.DataFrame(out, columns=["run_id", "claim_no", "start", "stop"]).astype({"start": "Int64", "stop": "Int64"})

    kind = dict(claims.dtypes)
    near = rows.mapInPandas(fuzzy, f"run_id {kind['run_id']}, claim_no {kind['claim_no']}, start long, stop long")
    return exact.where("start is not null").unionByName(near)


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Of overlapping spans the longer, then the earlier; equal ranges merge their places.

    The distinct spans of a run meet in one task: as many as an answer has claims.
    """
    merged = spans.where("start is not null").groupBy("run_id", "start", "stop").agg(F.array_sort(F.collect_set("place")).alias("places"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, starts, stops = [], [], []
        order = pdf.assign(_l=pdf["start"] - pdf["stop"]).sort_values(["_l", "start"])
        for i, start, stop in zip(order.index, order["start"].tolist(), order["stop"].tolist(), strict=True):
            # what is kept doesn't overlap, so only its neighbours can be in the way
            at = bisect_right(starts, start)
            if (at == 0 or stops[at - 1] <= start) and (at == len(starts) or stop <= starts[at]):
                starts.insert(at, start)
                stops.insert(at, stop)
                kept.append(i)
        return pdf.loc[sorted(kept)]

    return merged.groupBy("run_id").applyInPandas(greedy, merged.schema)


# ---------------------------------------------------------------- stored traces


def tool_steps(events: DataFrame, *, by: str = "run_id") -> DataFrame:
    """events(start_ns, end_ns, tool) numbered by start time, with their duration in milliseconds."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("start_ns", "span_id"))).withColumn("duration_ms", F.round((F.col("end_ns") - F.col("start_ns")) / 1e6, 3))


def tool_ancestors(spans: DataFrame, *, most_rounds: int = 40) -> DataFrame:
    """(trace_id, span_id, tool) for each tool span above a span of spans(trace_id, span_id, parent_id, kind), at any height.

    By pointer jumping: each round doubles the height that pointers leap and that
    tools are known up to, so a chain of n spans takes log2(n) rounds. A parent that
    is no span ends a chain; spans that are their own ancestors are an error.
    """
    ids = spans.select("trace_id", F.col("span_id").alias("up"), (F.col("kind") == "TOOL").alias("tool"))
    jump = stored(spans.where("parent_id is not null").select("trace_id", "span_id", F.col("parent_id").alias("up")).join(ids, ["trace_id", "up"]))
    found = jump.where("tool").select("trace_id", "span_id", F.col("up").alias("tool"))
    jump = jump.select("trace_id", "span_id", "up")
    for _ in range(most_rounds):
        if jump.isEmpty():
            return found
        ahead = found.select("trace_id", F.col("span_id").alias("up"), "tool")
        found = stored(found.unionByName(jump.join(ahead, ["trace_id", "up"]).select("trace_id", "span_id", "tool")))
        further = jump.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("far"))
        jump = stored(jump.join(further, ["trace_id", "up"]).select("trace_id", "span_id", F.col("far").alias("up")))
    raise ValueError("spans that are their own ancestors")


def retriever_metadata(spans: DataFrame) -> DataFrame:
    """(trace_id, tool_span, source_url, meta): retriever spans(trace_id, span_id, parent_id, kind, source_url, meta, start_ns) below each tool span; the first writer per address counts."""
    found = tool_ancestors(spans).join(spans.where("kind = 'RETRIEVER' and source_url is not null"), ["trace_id", "span_id"])
    return found.groupBy("trace_id", F.col("tool").alias("tool_span"), "source_url").agg(F.min_by("meta", F.struct("start_ns", "span_id")).alias("meta"))


def rated_runs(assessments: DataFrame, runs: DataFrame, least: float = 1.0) -> DataFrame:
    """Runs with a user rating of least or more, their step and citation ratings nested. assessments(run_id, name, value, scale, pos)."""
    stars = rating(F.col("value"), F.col("scale"))
    nested = lambda name: F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("pos", "value"))))
    rows = assessments.groupBy("run_id").agg(F.min_by(stars, F.when(F.col("name") == "user_rating", F.col("pos"))).alias("rating"), nested("step_quality").alias("step_ratings"), nested("citation").alias("citation_ratings"))
    return runs.join(rows.where(F.col("rating") >= least), "run_id")


def valid_triples(triples: DataFrame, allowed: DataFrame, *, rejected: bool = False) -> DataFrame:
    """triples(subject, relation, object) whose upper-cased labels the ontology's allowed(subject, relation, object) has; the others if rejected."""
    known = allowed.select(F.upper("subject").alias("_s"), F.col("relation").alias("_r"), F.upper("object").alias("_o")).distinct()
    on = (F.upper(triples["subject"]) == F.col("_s")) & (triples["relation"] == F.col("_r")) & (F.upper(triples["object"]) == F.col("_o"))
    return triples.join(known, on, "left_anti" if rejected else "left_semi")
