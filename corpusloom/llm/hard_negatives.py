"""Hard negatives by threshold joins over norm-bounded inverted indexes.

Rows lie in blocks of bounded size. A round asks, for each anchor, for the first
rows of its own label, or of others, in windows of scores above a threshold. A
block answers through an inverted index in the manner of L2AP: the dimensions of
a row from which on its remaining norm can't reach any anchor's threshold are in
no list, partial scores are summed list by list, and a row goes once the partial
score and the product of the remaining norms stay below the threshold. What is
left gets its exact score. Thresholds are lowered, round after round, for the
windows that aren't full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, joined_by_weight

#: Fixed values of the task: rows that are anchors, positives of an anchor, negatives of a pair, least and most share of the positive's score in hundredths.
ANCHOR_EVERY, POSITIVES, NEGATIVES, LEAST, MOST = 50, 5, 3, 50, 95
#: Rows of a block and of the part of a label that stays together; anchors that meet a block at once, and in one product.
BLOCK_ROWS, LABEL_ROWS, ASKED, STRIP = 2048, 1024, 8192, 256
#: Dimensions whose lists are summed between two prunings.
STEP = 8
#: Thresholds of the rounds: shares of an anchor's squared norm for positives (then none), and of a window's width for negatives.
POSITIVE_LEVELS, NEGATIVE_WIDTHS = (0.6, 0.3, None), (0.125, 0.5, 1.0)
NO_LIMIT = 1 << 62
#: Pairs that get their exact scores at once.
PAIRS = 1 << 14


def prepared(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(uid, vec_id, label, vector) of the rows that take part, stored: labels with their noise, uid a number of the row."""
    number, label = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long")
    own = vectors.select(number.alias("vec_id"), F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cut(own.where("label is not null and vector is not null").where(finite).withColumn("uid", F.monotonically_increasing_id()))


@dataclass
class Rows:
    """Some rows as arrays: numbers, ids (with those that are null), labels, and whole components, shorter vectors padded by zeros."""

    uid: np.ndarray
    ids: np.ndarray
    none: np.ndarray
    label: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(table: pa.Table | pa.StructArray, size: int = 0) -> Rows:
        uid, ids, label, vector = (table.field(c) if isinstance(table, pa.StructArray) else table.column(c).combine_chunks() for c in ("uid", "vec_id", "label", "vector"))
        length = np.asarray(vector.value_lengths(), np.int64)
        values = np.zeros((len(length), max(size, int(length.max(initial=0)))))
        row = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        values[row, place] = np.floor(256 * np.asarray(vector.flatten(), np.float64))
        return Rows(np.asarray(uid), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(label), values)


def _tails(values: np.ndarray) -> np.ndarray:
    """The norm of each row from each place on."""
    squares = np.cumsum(values[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(values), 1))], axis=1))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, whole and exact; beyond a long's limits they are these limits."""
    if not len(x):
        return np.zeros(0, np.int64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < 2**53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    return np.array([max(-NO_LIMIT, min(NO_LIMIT, sum(int(p) * int(q) for p, q in zip(a, b, strict=True)))) for a, b in zip(x, y, strict=True)], np.int64)


def candidates(asked: np.ndarray, low: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of all pairs whose inner product may reach the anchor's threshold, low.

    The inverted index of the rows: dimension j lists the rows whose norm from j on
    can reach a threshold. Rows are ordered by the number of their dimensions in
    lists, so a list is a prefix of them.
    """
    tail_x, tail_y = _tails(asked), _tails(rows)
    norm = tail_x[:, 0]
    # a little slack for sums of floating point
    slack = 1e-6 + 1e-9 * norm[:, None]
    reach = np.where(low > 0, low / np.maximum(norm, 1e-300), 0.0).min(initial=np.inf)
    depth = (tail_y[:, :-1] >= reach * (1 - 1e-9)).sum(axis=1) if reach > 0 else np.full(len(rows), rows.shape[1])
    left = np.argsort(-depth, kind="stable")
    # a row in no list reaches no threshold
    left = left[: np.count_nonzero(depth)]
    score = np.zeros((len(asked), len(left)))
    for at in range(0, int(depth.max(initial=0)), STEP):
        listed = int(np.count_nonzero(depth[left] > at))
        place = np.arange(at, min(at + STEP, rows.shape[1]))
        lists = np.where(place < depth[left[:listed], None], rows[left[:listed, None], place], 0.0)
        score[:, :listed] += asked[:, place] @ lists.T
        end = np.minimum(at + STEP, depth[left])
        most = score + tail_x[:, end] * tail_y[left, end] * (1 + 1e-9) + slack
        near = (most >= low[:, None]).any(axis=0)
        if not near.all():
            left, score = left[near], score[:, near]
    end = depth[left]
    most = score + tail_x[:, end] * tail_y[left, end] * (1 + 1e-9) + slack
    anchor, row = np.nonzero(most >= low[:, None])
    return anchor, left[row]


def answers(asked: Rows, low: np.ndarray, high: np.ndarray, rows: Rows, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(anchor, window, row, score): for each window low[a, w] to high[a, w] of each anchor the first k rows of its own label, or of others; windows with low over high are none."""
    # dimensions with most of the rows' mass come first
    order = np.argsort(-(rows.values**2).sum(axis=0), kind="stable")
    x, y = asked.values[:, order], rows.values[:, order]
    least = np.where(low <= high, low, NO_LIMIT).min(axis=1, initial=NO_LIMIT)
    out = []
    for top in range(0, len(x), STRIP):
        a, r = candidates(x[top : top + STRIP], least[top : top + STRIP].astype(float), y)
        a += top
        wanted = ((asked.label[a] == rows.label[r]) == same) & (asked.uid[a] != rows.uid[r])
        a, r = a[wanted], r[wanted]
        score = np.concatenate([exact(x[a[lo : lo + PAIRS]], y[r[lo : lo + PAIRS]]) for lo in range(0, max(1, len(a)), PAIRS)])
        first = np.lexsort((rows.uid[r], rows.ids[r], rows.none[r], -score, a))
        a, r, score = a[first], r[first], score[first]
        for w in range(low.shape[1]):
            inside = np.flatnonzero((low[a, w] <= score) & (score <= high[a, w]))
            run = np.flatnonzero(np.r_[True, a[inside][1:] != a[inside][:-1]][: len(inside)])
            rank = np.arange(len(inside)) - np.repeat(run, np.diff(np.r_[run, len(inside)]))
            best = inside[rank < k]
            out.append((a[best], np.full(len(best), w), r[best], score[best]))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4))


def threshold_join(blocks: DataFrame, asked: DataFrame, k: int, *, same: bool, n_blocks: int) -> DataFrame:
    """(uid, no, other, other_id, score): the first k rows of each window of asked(uid, vec_id, label, vector, n_parts, windows), stored.

    windows are (no, low, high); rows are of the anchor's own label if same, else of
    others. An anchor meets the blocks that can hold such rows, each in groups of
    about ASKED anchors.
    """
    n_groups = max(1, -(-asked.count() // ASKED))
    meets = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n_parts") - 1), lambda s: _block(F.col("label"), s, n_blocks))) if same else F.sequence(F.lit(0), F.lit(n_blocks - 1))
    sent = asked.select(F.explode(meets).alias("block"), F.pmod(F.xxhash64("uid"), F.lit(n_groups)).cast("int").alias("part"), "uid", "vec_id", "label", "vector", "windows")
    kept = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part"), "rows")

    def met(table: pa.Table) -> pa.Table:
        given = table.column("rows").is_valid()
        own, asks = table.filter(given).column("rows").combine_chunks().flatten(), table.filter(pc.invert(given))
        windows = asks.column("windows").combine_chunks()
        found = [np.zeros(0, np.int64)] * 4
        if len(own) and len(asks):
            most = max(int(np.asarray(v.value_lengths()).max(initial=0)) for v in (own.field("vector"), asks.column("vector").combine_chunks()))
            rows, anchors = Rows.of(own, most), Rows.of(asks, most)
            size = np.asarray(windows.value_lengths(), np.int64)
            flat = windows.flatten()
            low, high, no = (np.full((len(size), size.max()), v, np.int64) for v in (NO_LIMIT, -NO_LIMIT, 0))
            a = np.repeat(np.arange(len(size)), size)
            w = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
            for put, name in ((low, "low"), (high, "high"), (no, "no")):
                put[a, w] = np.asarray(flat.field(name))
            a, w, r, score = answers(anchors, low, high, rows, k, same)
            found = [anchors.uid[a], no[a, w], rows.uid[r], pa.array(rows.ids[r], mask=rows.none[r]), score]
        else:
            found.insert(3, found[0])
        return pa.table({n: c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for n, c in zip(("uid", "no", "other", "other_id", "score"), found, strict=True)})

    dealt = kept.unionByName(sent, allowMissingColumns=True).groupBy("block", "part")
    found = dealt.applyInArrow(met, "uid long, no long, other long, other_id long, score long")
    order = Window.partitionBy("uid", "no").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _block(label: Column, part: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(label, part), F.lit(n_blocks)).cast("int")


def _window(level: int) -> Callable[[Column], Column]:
    return lambda w: F.struct(w["no"].alias("no"), w["lows"][level].alias("low"), w["high"].alias("high"))


def _rounds(blocks: DataFrame, asked: DataFrame, levels: tuple, k: int, *, same: bool, n_blocks: int) -> DataFrame:
    """threshold_join of asked(..., wanted), level after level, each time for the windows with fewer than k rows; wanted has a window's lows, a level each."""
    done = None
    for n in range(len(levels)):
        now = asked.select(*(c for c in asked.columns if c != "wanted"), F.transform("wanted", _window(n)).alias("windows"))
        found = threshold_join(blocks, now, k, same=same, n_blocks=n_blocks)
        if n + 1 == len(levels):
            return found if done is None else done.unionByName(found)
        full = found.where(F.col("rank") == k).select("uid", "no")
        ended = found.join(full, ["uid", "no"])
        done = ended if done is None else done.unionByName(ended)
        each = asked.withColumn("w", F.explode("wanted")).withColumn("no", F.col("w.no"))
        rest = each.join(full, ["uid", "no"], "left_anti").groupBy("uid").agg(F.collect_list("w").alias("wanted"))
        asked = cut(asked.drop("wanted").join(rest, "uid"))
        if asked.isEmpty():
            return done
    return done


def mine(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive, best first.

    Rows with a null label or vector or a component that is null or not finite
    take no part. Rows with one id are rows by themselves, each with its answers;
    a null id is no anchor and comes after others among equal scores. Of two
    vectors the shorter counts as if zeros followed. Scores are exact whole
    numbers; those that no long can hold are as its limits. An anchor without
    another row of its label, a pair without a row in its window, and an empty
    table give no rows.
    """
    own = prepared(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    sizes = cut(own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("n_parts", F.ceil(F.col("n") / LABEL_ROWS).cast("int")))
    n_blocks = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // BLOCK_ROWS))
    placed = joined_by_weight(own, sizes, ["label"]).drop("n")
    placed = cut(placed.withColumn("block", _block(F.col("label"), F.pmod(F.xxhash64("uid"), F.col("n_parts")).cast("int"), n_blocks)))
    blocks = cut(placed.groupBy("block").agg(F.collect_list(F.struct("uid", "vec_id", "label", "vector")).alias("rows")))
    anchors = placed.where(F.col("vec_id") % every == 0).drop("block")

    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(256 * x).cast("double"), 2))
    lows = F.array(*(F.lit(-NO_LIMIT) if level is None else F.least(F.lit(float(1 << 60)), level * square).cast("long") for level in POSITIVE_LEVELS))
    whole = F.struct(F.lit(0).cast("long").alias("no"), lows.alias("lows"), F.lit(NO_LIMIT).alias("high"))
    near = _rounds(blocks, anchors.withColumn("wanted", F.array(whole)), POSITIVE_LEVELS, positives, same=True, n_blocks=n_blocks)
    near = cut(near.select("uid", F.col("rank").cast("long").alias("no"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))

    def share(hundredths: int, up: int) -> Column:
        return F.call_function("div", F.col("positive_score").cast("decimal(20,0)") * hundredths + up, F.lit(100).cast("decimal(3,0)"))

    bounds = near.where("positive_score >= 0").select("uid", "no", share(least, 99).alias("low"), share(most, 0).alias("high")).where("low <= high")
    steps = F.array(*(F.col("high") - ((F.col("high") - F.col("low")) * w).cast("long") if w < 1 else F.col("low") for w in NEGATIVE_WIDTHS))
    wanted = bounds.groupBy("uid").agg(F.collect_list(F.struct("no", steps.alias("lows"), "high")).alias("wanted"))
    found = _rounds(blocks, cut(anchors.join(wanted, "uid")), NEGATIVE_WIDTHS, negatives, same=False, n_blocks=n_blocks)
    told = found.select("uid", "no", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid").join(told, ["uid", "no"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """The hard negatives of embeddings in DuckDB's SQL, for tables of some thousand rows."""
    score = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT"
    return f"""
WITH r AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id AS other_id, a.label = b.label AS same, {score} AS score FROM r a JOIN r b ON a.uid <> b.uid WHERE a.vec_id % {ANCHOR_EVERY} = 0),
near AS (SELECT uid, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, other_id, other) <= {POSITIVES}),
pairs AS (SELECT n.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY n.uid, n.positive ORDER BY s.score DESC, s.other_id, s.other) AS rank
  FROM near n JOIN scores s ON n.uid = s.uid AND NOT s.same AND {LEAST} * n.positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * n.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= {NEGATIVES}"""
