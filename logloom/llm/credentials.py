"""Secrets in text, as spans, and credentials whose parts stand near each other.

Strong kinds are reported wherever they match. Weak ones (identifiers, keys and
endpoints that occur in harmless text as well) are candidates only: an interval
join within scopes of ``scope`` code points finds their complements, and they
are reported where these co-occur. All of it is DataFrame expressions.

Positions come from the lengths of a pattern's matches and of the text between
them, summed by a window over the rows of one text; the text itself never moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import fresh, small_if_measured
from logloom.session import cut_lineage

# Strong kinds: pattern, the group whose length counts, and its least length
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
# Weak kinds: an account or key name with its value, a mixed token as keys are, a host to use them at
WEAK = {
    "identifier": (r"""(?i:user(?:_?name)?|login|client_?id|access_?key_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", 0, 6),
    "key": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    "endpoint": (r"(?i:https?|wss?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?#&=%+-]+", 0, 8),
}
KINDS = [*STRONG, *WEAK]
SCOPE = 200
# What a kind is a part of: who, with what, where
PART = {"access": "who", "identifier": "who", "assign": "what", "hex": "what", "key": "what", "endpoint": "where"}
REDACTED = "[REDACTED]"


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: equal rows have equal spans, so they may share one."""
    text = F.coalesce(text_col, F.lit(""))
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def matches(docs: DataFrame, id_col: str, text_col: str, kinds: dict) -> DataFrame:
    """(key, kind, start, end) of all matches long enough, leftmost and non-overlapping per kind.

    The patterns' own minimum is in the pattern where a failing shorter match
    cannot hide a later one: a run that is too short is so from every start in it.
    An ``assign`` match that fails does hide others, and is matched before it is dropped.
    """
    text = F.coalesce(text_col, F.lit(""))

    def found(kind: str) -> Column:
        pattern, group, _ = kinds[kind]
        has = text.rlike(pattern)
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        sized = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        gaps = F.split(text, pattern, -1)
        pieces = F.transform(
            F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), sized.alias("sized")),
            lambda p, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), F.length(p["sized"]).alias("sized")
            ),
        )
        return F.when(has, pieces)

    none = F.array().cast("array<struct<kind:string,i:int,gap:int,hit:int,sized:int>>")
    rows = docs.select(
        row_key(id_col, text_col).alias("key"), F.explode(F.concat(*[F.coalesce(found(k), none) for k in kinds])).alias("m")
    )
    rows = rows.select("key", "m.*").distinct()
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = F.lit(0)
    for kind, (_, _, size) in kinds.items():
        least = F.when(F.col("kind") == kind, size).otherwise(least)
    end = F.sum(F.col("gap").cast("bigint") + F.col("hit")).over(upto)
    return rows.withColumn("end", end).filter(F.col("sized") >= least).select(
        "key", "kind", (F.col("end") - F.col("hit")).alias("start"), "end"
    )


def linked(strong: DataFrame, weak: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans in whose scope their complements are.

    Two spans share a scope if at most ``scope`` code points lie between them. A
    weak ``who`` needs a ``what``, a weak ``what`` a ``who``, a ``where`` both.
    Spans meet by the blocks of text they reach, which hold a bounded number of
    spans of a kind; every candidate leaves one row.
    """
    parts = strong.unionByName(weak)
    part = F.element_at(F.create_map(*[F.lit(x) for pair in PART.items() for x in pair]), F.col("kind"))
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    near = parts.select(
        "key", part.alias("p"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(first - 1, last + 1)).alias("block")
    )
    wanted = weak.withColumn("block", F.explode(F.sequence(first, last))).withColumn("own", part)
    met = wanted.join(near, ["key", "block"]).filter((F.col("s") <= F.col("end") + scope) & (F.col("e") >= F.col("start") - scope))
    has = lambda p: F.max(F.when(F.col("p") == p, 1).otherwise(0)) == 1
    seen = met.groupBy("key", "kind", "start", "end", "own").agg(has("who").alias("who"), has("what").alias("what"))
    complete = F.when(F.col("own") == "who", F.col("what")).when(F.col("own") == "what", F.col("who")).otherwise(F.col("who") & F.col("what"))
    return seen.filter(complete).select("key", "kind", "start", "end")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, kind, start, end) of every secret in the whole texts of ``docs``.

    Offsets count code points, ends are exclusive. Null texts are empty. Rows that
    agree in id and text share one key and one set of spans.
    """
    every = cut_lineage(matches(docs, id_col, text_col, {**STRONG, **WEAK}))
    strong = every.filter(F.col("kind").isin(*STRONG))
    weak = every.filter(F.col("kind").isin(*WEAK))
    return strong.unionByName(linked(strong, weak, scope))


def listed(found: DataFrame) -> DataFrame:
    """(key, spans): the spans of a text in the order of their start, then of their kind."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("spans"))


def as_text(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` replaced by a mark; overlapping spans become one mark.

    All rows and columns stay; a null text stays null.
    """
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = (
        found.withColumn("reach", F.max("end").over(before))
        .withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))
        .withColumn("island", F.sum("new").over(upto))
        .groupBy("key", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    key, cuts = fresh(docs, "row_key"), fresh(docs, "cuts")
    lists = cut_lineage(
        islands.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    )
    lists = small_if_measured(lists, F.size(cuts) * 16 + 96)
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.col(f"{cuts}.end"))
    ends = F.concat(F.col(f"{cuts}.start"), F.array(F.length(text_col).cast("bigint")))
    kept = F.transform(
        F.arrays_zip(begins.alias("b"), ends.alias("e")),
        lambda p: F.substring(F.col(text_col), (p["b"] + 1).cast("int"), (p["e"] - p["b"]).cast("int")),
    )
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(lists, key, "left")
    clean = F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(F.array_join(kept, REDACTED))
    return joined.withColumn(text_col, clean).select(*docs.columns)
