"""Reply trees to chat conversations.

Messages name the message they reply to. Iterated self-joins look up ancestors
at doubling distances, so a tree of depth d takes log2(d) rounds: they give each
leaf the score of its branch, and then all messages on the branches chosen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.spread import first_n, with_ordinal
from logloom.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """Text in which ``<|`` cannot occur: one backslash more between the two signs."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def reply_trees(messages: DataFrame) -> DataFrame:
    """(node, tree_id, up, score, role, text) of messages (tree_id, msg_id, parent_id, role, text, score).

    Repeated (tree_id, msg_id) count once, as the row with the least (parent, role,
    text, score). A parent that is not in the tree makes a root. Null roles and
    texts are empty, null scores 0; a null tree id is a tree, a null message id a message.
    """
    rest = [
        F.col("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    ]
    rows = messages.select(F.struct("tree_id", "msg_id").alias("node"), F.struct(*rest).alias("m"))
    rows = rows.groupBy("node").agg(F.min("m").alias("m"))
    parents = rows.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    named = rows.select(
        "node",
        F.when(F.col("m.parent_id").isNotNull(), F.struct(F.col("node.tree_id"), F.col("m.parent_id").alias("msg_id"))).alias("up"),
        "m.score",
        "m.role",
        "m.text",
    )
    return named.join(parents, "up", "left").select(
        "node", "node.tree_id", F.when(F.col("there"), F.col("up")).alias("up"), "score", "role", "text"
    )


def ancestors(trees: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Per message the sum of scores and number of messages up to its root, and the jump tables.

    Table k is (node, up) with the ancestor 2**k steps up. Messages on a cycle of
    replies, or behind one, have no root; they are left out of the first frame.
    """
    state = cut_lineage(
        trees.select("node", "up", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("steps"))
    )
    nodes, jumps = state.count(), []
    while True:
        open_ = state.filter("up is not null")
        left = open_.count()
        if not left or 1 << len(jumps) > nodes:
            break
        jumps.append(open_.select("node", "up"))
        above = state.select(
            F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("on")
        )
        moved = open_.join(above, "up").select(
            "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("on")).alias("steps")
        )
        state = cut_lineage(state.filter("up is null").unionByName(moved))
    return state.filter("up is null").drop("up"), jumps


def branches(trees: DataFrame, sums: DataFrame, top: int | None = None) -> DataFrame:
    """(leaf, tree_id, steps, score, rank): root-to-leaf paths, best mean score first, ties by message id.

    ``top`` keeps that many per tree; without it all are ranked.
    """
    inner = trees.filter("up is not null").select(F.col("up").alias("node")).distinct()
    leaves = (
        sums.join(inner, "node", "left_anti")
        .select(
            F.col("node").alias("leaf"), "node.tree_id", "node.msg_id", "steps", (F.col("total") / F.col("steps")).alias("score")
        )
    )
    order = [F.col("score").desc(), F.col("msg_id")]
    if top is None:
        ranked = with_ordinal(leaves, ["tree_id"], order, name="rank")
    else:
        ranked = first_n(leaves, ["tree_id"], order, top, spread_by=["msg_id"])
    return ranked.drop("msg_id")


def path_messages(trees: DataFrame, chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, place, role, text): every message of the chosen branches, root at place 0."""
    found = chosen.select("leaf", F.col("leaf").alias("node"), "steps", F.lit(0).cast("bigint").alias("back"))
    for k, jump in enumerate(jumps):
        further = found.join(jump, "node").select("leaf", F.col("up").alias("node"), "steps", (F.col("back") + (1 << k)).alias("back"))
        found = cut_lineage(found.unionByName(further))
    return found.join(trees.select("node", "role", "text"), "node").select(
        "leaf", (F.col("steps") - 1 - F.col("back")).alias("place"), "role", "text"
    )


def conversations(messages: DataFrame, top: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One formatted conversation per chosen branch of ``messages``.

    Returns (tree_id, leaf_id, rank, score, n_turns, formatted, loss_spans). Turns
    are marked by control strings, which texts and roles hold escaped. Loss spans
    (start, end) cover the escaped text of each ``loss_role`` turn, in code points
    of ``formatted``, end exclusive. No messages, no conversations. Messages on a
    cycle of replies, or behind one, have no root and are in no conversation.
    """
    trees = cut_lineage(reply_trees(messages))
    sums, jumps = ancestors(trees)
    chosen = cut_lineage(branches(trees, sums, top))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turns = path_messages(trees, chosen, jumps).select(
        "leaf", "place", (F.col("role") == loss_role).alias("counts"), head.alias("head"), escaped(F.col("text")).alias("body")
    )
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("turn").cast("bigint")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("counts"), F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("body")).alias("end")))
    whole = (
        turns.withColumn("begin", begin)
        .select("leaf", "place", "turn", span.alias("span"))
        .groupBy("leaf")
        .agg(F.array_sort(F.collect_list(F.struct("place", "turn", "span"))).alias("turns"))
    )
    return whole.join(chosen, "leaf").select(
        "tree_id",
        F.col("leaf.msg_id").alias("leaf_id"),
        "rank",
        "score",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation, as they were before formatting."""
    turns, at = [], 0
    for found in TURN.finditer(formatted):
        if found.start() != at:
            break
        turns.append((unescaped_role(found[1]), unescaped(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def digests(formatted: Column, spans: Column) -> Column:
    """What reading a conversation back gives: turns and loss text, as counts and SHA-256."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def of(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends in parts:
            rows = []
            for text, first, last in zip(texts, starts, ends):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescaped(text[a:b]) for a, b in zip(first, last))
                rows.append((len(turns), sha256(said), len(loss), sha256(loss), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return of(formatted, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
