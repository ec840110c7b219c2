"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose share (a count over another count) lies beyond a
cutoff. Labelled texts are the holdout: for every stratum, rule and cutoff of a
fixed grid the rejected good texts are counted, and a cutoff is certified if the
exact binomial bound of its false rejection rate is at most the rule's part of
``risk``, which is the case if so few rejections have a probability of at most
``error / (strata * rules)`` under a rate beyond it. Rejections only grow along a
rule's cutoffs, so testing these in order needs no correction; testing many
strata and rules does, hence the division (Bonferroni). With probability
1 - ``error`` or more, no stratum loses more than ``risk`` of its good texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import lookup
from logloom.llm.common import BROADCAST_BYTES, small_if_measured
from logloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 3
RISK = 0.02
ERROR = 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * ``count`` is over ``cutoff * per``, or under it if ``low``; cutoffs from lenient to strict."""

    name: str
    count: str
    per: str
    cutoffs: tuple[int, ...]
    low: bool = False

    def rejects(self, cutoff: Column) -> Column:
        count, limit = F.lit(1000) * F.col(self.count), cutoff * F.col(self.per)
        return count < limit if self.low else count > limit


RULES = (
    Rule("symbols", "n_symbols", "n_words", (5000, 3000, 2000, 1500, 1000, 700, 500, 300, 200, 150, 100, 70, 50)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (900, 800, 700, 600, 500, 400, 350, 300, 250, 200)),
    Rule("repeated_words", "n_repeat_words", "n_words", (480, 450, 400, 350, 300, 250, 200, 150, 100)),
    Rule("long_words", "word_chars", "n_words", (20000, 15000, 12000, 11000, 10000, 9500, 9000, 8500, 8000, 7500)),
    Rule("short_words", "word_chars", "n_words", (1500, 2000, 2500, 3000, 3500, 4000, 4500), low=True),
)


def counts_of(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    # bytes are split at exactly the characters that end a word: space and tab to carriage return
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside of windows of ``width`` words that the text holds twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    window = ids[:n]
    # pairs are renumbered at every step, so keys stay below the square of the words
    for i in range(1, width):
        window = np.unique(window * len(words) + ids[i : i + n], return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(width):
        covered[i : i + n] |= again
    return int(covered.sum())


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without their text but with ``COUNTS`` and ``copy``, a hash of the text."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([counts_of(t) for t in part], columns=list(COUNTS), dtype="int64")

    text = F.col(text_col)
    rest = [c for c in docs.columns if c != text_col]
    found = docs.select(*rest, F.xxhash64(F.coalesce(text, F.lit(""))).alias("copy"), of(text).alias("counts"))
    return found.select(*rest, "copy", "counts.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(rejected: int, trials: int, rate: float) -> float:
    """The probability of at most ``rejected`` in ``trials`` at ``rate``, exact up to rounding."""
    if not trials or rejected >= math.ceil(trials * rate):
        # beyond the median it is a half or more, which certifies nothing
        return 1.0
    term = math.exp(
        math.lgamma(trials + 1) - math.lgamma(rejected + 1) - math.lgamma(trials - rejected + 1)
        + rejected * math.log(rate) + (trials - rejected) * math.log1p(-rate)
    )
    total, i = 0.0, rejected
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - rate) / ((trials - i + 1) * rate)
        i -= 1
    return total


def certified(
    labelled: DataFrame, stratum: str, rules: Sequence[Rule] = RULES, risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """(stratum, one column per rule): the cutoffs in force; null where a rule is off.

    ``labelled`` holds ``stratum``, ``good`` (boolean), ``copy`` and ``COUNTS`` of
    the texts the rules will judge. Rows of one ``copy`` in a stratum are one draw,
    good if any of them is. Of the certified cutoffs the one that rejects most bad
    texts is taken, of equal ones the most lenient; a rule that rejects bad texts
    no more often than good ones is off, as is every rule of a stratum with too
    few labels. Counts are aggregates; only the number of strata reaches the driver.
    """
    draws = labelled.groupBy(stratum, "copy").agg(F.max("good").alias("good"), *[F.max(c).alias(c) for c in COUNTS])
    steps = [(r, i, c) for r in rules for i, c in enumerate(r.cutoffs)]
    beyond = [F.sum((r.rejects(F.lit(c)) & F.col("good")).cast("long")).alias(f"g{n}") for n, (r, _, c) in enumerate(steps)]
    beyond += [F.sum((r.rejects(F.lit(c)) & ~F.col("good")).cast("long")).alias(f"b{n}") for n, (r, _, c) in enumerate(steps)]
    totals = cut_lineage(
        draws.groupBy(stratum).agg(
            F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"), *beyond
        )
    )
    level = error / (max(1, totals.count()) * len(rules))
    rate = risk / len(rules)

    @F.pandas_udf("boolean")
    def holds(rejected: pd.Series, trials: pd.Series) -> pd.Series:
        return pd.Series([tail(int(k), int(n), rate) <= level for k, n in zip(rejected, trials)], dtype=bool)

    tests = totals.select(
        stratum,
        "good",
        "bad",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"g{n}").alias("g"), F.col(f"b{n}").alias("b"))
                    for n, (r, i, c) in enumerate(steps)
                ]
            )
        ).alias("t"),
    ).select(stratum, "good", "bad", "t.*")
    useful = tests.filter(F.col("b") * F.col("good") > F.col("g") * F.col("bad")).filter(holds("g", "good"))
    # few rules per stratum: one small group each
    picked = useful.groupBy(stratum, "rule").agg(F.max_by("cutoff", F.struct("b", -F.col("step"))).alias("cutoff"))
    return totals.select(stratum).join(
        picked.groupBy(stratum).pivot("rule", [r.name for r in rules]).agg(F.first("cutoff")).withColumnRenamed(stratum, "_s"),
        F.col(stratum).eqNullSafe(F.col("_s")),
        "left",
    ).drop("_s")


def judged(counted: DataFrame, cutoffs: DataFrame, stratum: str, spread_by: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """``counted`` with ``rejected_by``, the rules of its stratum that reject a row; strata without cutoffs reject none.

    A stratum's cutoffs are a row of some bytes: they are broadcast if their
    measured size allows it, else joined with large strata split.
    """
    cutoffs = cut_lineage(cutoffs)
    width = 40 + 8 * len(rules)
    if cutoffs.count() * width <= BROADCAST_BYTES:
        joined = counted.join(small_if_measured(cutoffs, width), stratum, "left")
    else:
        joined = lookup(counted, cutoffs, [stratum], spread_by)
    hit = F.array(*[F.when(r.rejects(F.col(r.name)), F.lit(r.name)) for r in rules])
    return joined.select(*counted.columns, F.array_compact(hit).alias("rejected_by"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: Column | None = None,
    rules: Sequence[Rule] = RULES,
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """(doc_id, stratum, counts, base_failed, rejected_by, kept) per row of ``docs`` (doc_id, text, lang).

    ``stratum`` is by default the language, ``und`` where it is null. ``labels``
    (doc_id, quality 0 or 1) count where they have a document that passes the base
    rules; other values and null ids are passed over, and a document that is
    labelled both ways is good. Null and empty texts have no words and fail the
    base rules. Without labels only the base rules reject. The texts are read once;
    other columns of either table are not read.
    """
    stratum = F.coalesce(F.col("lang"), F.lit("und")) if stratum is None else stratum
    counted = with_counts(docs.select("doc_id", stratum.alias("stratum"), "text"))
    counted = cut_lineage(counted.withColumn("base_failed", base_failed()))
    marks = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.max("quality") == 1).alias("good"))
    )
    labelled = counted.filter(~F.col("base_failed")).join(marks, "doc_id")
    cutoffs = certified(labelled, "stratum", rules, risk, error)
    found = judged(counted, cutoffs, "stratum", ["copy", "doc_id"], rules)
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("copy")
