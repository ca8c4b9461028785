"""Secrets in texts, with the parts of one credential linked to each other.

Strong spans (assigned secrets, access identifiers, hexadecimal keys) are always
reported. Weak ones (short assigned secrets, account names, long mixed tokens,
endpoints) are common in clean text; they are reported only where the part that
completes them stands in the same scope, a block between blank lines, within
``reach`` code points and apart from them: what overlaps, as a key in an address
does, is no second part. The interval join sweeps the ends and starts of each
scope's parts once in either direction, so that a part meets the nearest
complement on each side and never every other part. A bare hexadecimal key is a
commit or a checksum as often as a secret: it completes nothing by itself, only
where a word of credentials introduces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, plain_docs, unboxed

REACH = 300
#: The patterns that the base kinds are defined by.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: kind: (pattern, group whose length counts, least length of it, role); the order breaks ties between spans. What is told in prose is no span of its own.
KINDS = {
    "assign": (ASSIGN, 2, 12, "secret"),
    "access": (ACCESS, 0, 18, "account"),
    "hex": (HEX, 0, 16, None),
    "short": (ASSIGN, 2, 6, "secret"),
    "account": (r"""((?i:client_?id|account|user_?name|login|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 4, "account"),
    "blob": (r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}", 0, 32, "secret"),
    "told": (r"""(?<![A-Za-z0-9])(?i:passw(?:or)?d|passphrase|secret|token|credentials?|(?:api|secret|private|access)[ _-]?key)(?:[\x20:='"]+(?:is|was|key|value))?[\x20:='"]+[0-9a-f]{16,}""", 0, 16, "secret"),
    "endpoint": (r"""(?:https?|ftps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""", 0, 8, "endpoint"),
}
ROLES = ("secret", "account", "endpoint")
BASE, WEAK = ("assign", "access", "hex"), ("short", "account", "blob", "endpoint")
#: What each weak kind needs beside it: any role of the tuple.
NEEDS = {"short": ("account", "endpoint"), "account": ("secret",), "blob": ("account", "endpoint"), "endpoint": ("secret",)}
_HIT = "array<struct<kind:int,i:int,gap:int,size:int,inner:int>>"


def _hits(text: Column, kind: int, pattern: str, group: int) -> Column:
    """The matches of a pattern, each with the length of the gap before it."""
    lengths = lambda x: F.transform(x, lambda s: F.length(s))
    zipped = F.arrays_zip(lengths(F.split(text, pattern, -1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # a match is matched alike by itself, so its group is cut from it
    inner = lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m)
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["0"].alias("gap"), F.length(x["1"]).alias("size"), inner(x["1"]).alias("inner")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(_HIT))


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, text_hash, copies, spans): one row for each distinct (doc_id, text), spans an array of (start, kind, stop, name) by start, then kind.

    Positions count code points, stop is exclusive. A null or empty text has no
    spans; a null doc_id is kept; rows repeated exactly are counted in copies.
    """
    text = F.col("text")
    patterns = {}
    for no, (pattern, group, _, _) in enumerate(KINDS.values()):
        patterns.setdefault(pattern, (no, group))
    blank = len(KINDS)
    arrays = [_hits(text, no, p, g) for p, (no, g) in patterns.items()] + [_hits(text, blank, r"\n[ \t\r]*\n", 0)]
    rows = plain_docs(docs, id_col=id_col, text_col=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(F.concat(*arrays)).alias("x")).select("doc_id", "text_hash", "x.*")
    rows = rows.where("size is not null or kind is null").repartition("doc_id", "text_hash")
    rows = rows.groupBy("doc_id", "text_hash", "kind", "i").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("inner").alias("inner"), F.count(F.lit(1)).alias("copies"))
    own = Window.partitionBy("doc_id", "text_hash")
    stop = F.sum(F.col("gap") + F.col("size")).over(own.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    # an assigned value that is too short for the base kind is a weak candidate
    names = list(KINDS)
    short = (F.col("kind") == names.index("assign")) & (F.col("inner") < KINDS["assign"][2])
    rows = rows.withColumn("kind", F.when(short, names.index("short")).otherwise(F.col("kind")))
    least = F.coalesce(*(F.when(F.col("kind") == i, F.lit(KINDS[n][2])) for i, n in enumerate(names)), F.lit(0))
    # what is too short is no span, but its row still stands for its document
    rows = rows.withColumn("kind", F.when(F.col("inner") >= least, F.col("kind")))
    role = F.coalesce(*(F.when(F.col("kind") == i, F.lit(KINDS[n][3])) for i, n in enumerate(names)))
    rows = rows.withColumn("role", role).withColumn("scope", F.count(F.when(F.col("kind") == blank, 1)).over(own.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    # each part is an event where it starts, which looks back, and one where it stops, which looks ahead
    events = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("opens")).withColumn("at", F.when(F.col("opens"), F.col("start")).otherwise(F.col("stop")))
    scope = Window.partitionBy("doc_id", "text_hash", "scope")
    ahead, back = (scope.orderBy(c("at"), c("opens"), "kind", "start").rowsBetween(Window.unboundedPreceding, 0) for c in (F.asc, F.desc))
    for r in ROLES:
        events = events.withColumn(f"before_{r}", F.max(F.when(~F.col("opens") & (F.col("role") == r), F.col("stop"))).over(ahead))
    for r in ROLES:
        events = events.withColumn(f"after_{r}", F.min(F.when(F.col("opens") & (F.col("role") == r), F.col("start"))).over(back))
    beside = lambda r: F.when(F.col("opens"), F.col("start") - F.col(f"before_{r}") <= reach).otherwise(F.col(f"after_{r}") - F.col("stop") <= reach)
    linked = F.lit(False)
    for name, needs in NEEDS.items():
        for r in needs:
            linked = linked | ((F.col("kind") == names.index(name)) & F.coalesce(beside(r), F.lit(False)))
    keep = F.col("kind").isin([names.index(n) for n in BASE]) | linked
    name = F.coalesce(*(F.when(F.col("kind") == i, F.lit(n)) for i, n in enumerate(names)))
    span = F.when(keep, F.struct("start", "kind", "stop", name.alias("name")))
    return events.groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_set(span)).alias("spans"))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts of the base kinds, the digest of the base spans, and all spans as text."""
    rows = secret_spans(docs, id_col=id_col, text_col=text_col)
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s["name"] == n)).cast("long").alias(f"n_{n}")
    base = F.filter("spans", lambda s: s["name"].isin(*BASE))
    out = rows.select("doc_id", *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), *map(count, WEAK), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text_col replaced by mark; overlapping spans become one mark. A null text gives an empty one, texts without spans and all other columns stay as they are, whatever their names."""
    spans = secret_spans(docs, id_col=id_col, text_col=text_col).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans")
    own = boxed(docs, text=F.coalesce(F.col(text_col), F.lit("")), id=F.col(id_col).cast("long")).withColumn("hash", F.xxhash64("text"))
    joined = own.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] < acc["at"], F.array().cast("array<string>")).otherwise(F.array(F.substring(F.col("text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    return unboxed(joined, docs, {text_col: F.when(F.col("spans").isNull(), F.col("text")).otherwise(done)})
