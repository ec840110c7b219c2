"""Language identification by words, with backoff to character n-grams.

A word seen in training scores its per-language log frequency. An unseen one
falls back to the n-grams of the word between boundary marks: the longest order
of which any n-gram is known decides, down to single letters. A text's language
is the one with the largest sum over its words; its score is the mean
probability its words give that language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import cut_lineage

UNKNOWN = "und"
# Characters of training text per language: the bound of the fitted sample
SAMPLE_CHARS = 300_000
# Characters of training text of one language times the square of their number, at most: bounds the
# model, which has a column per language (14 languages get all of SAMPLE_CHARS, 100 get 6,700)
MODEL_CELLS = 1 << 26
# Characters of a block of training text, and those a word begun in it may have beyond it
BLOCK_CHARS = 1_000
WORD_CHARS = 100
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
# Words whose scores a worker keeps, and characters it scores at a time
KEPT = 150_000
CHUNK = 1 << 19
TOKEN = re.compile(r"[^\W\d_]+")
EDGE = "\x02"


@dataclass(frozen=True)
class Model:
    """Log frequencies per language: a row of ``logs`` for each of ``items``, words (``kinds`` 0) and n-grams.

    Items are one column of text, not objects; workers make dictionaries of them.
    """

    languages: tuple[str, ...]
    items: pa.Array
    kinds: np.ndarray
    logs: np.ndarray

    @cached_property
    def words(self) -> dict[str, int]:
        return self._named(self.kinds == 0)

    @cached_property
    def grams(self) -> dict[str, int]:
        return self._named(self.kinds > 0)

    def _named(self, which: np.ndarray) -> dict[str, int]:
        at = np.flatnonzero(which)
        return dict(zip(self.items.take(pa.array(at)).to_pylist(), at.tolist()))

    def __getstate__(self):
        """The columns only, not what was made of them."""
        return {k: self.__dict__[k] for k in ("languages", "items", "kinds", "logs")}

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies per word; zeros where nothing is known of it."""
        out = np.zeros((len(words), len(self.languages)))
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[known >= 0] = self.logs[known[known >= 0]]
        open_ = np.flatnonzero(known < 0)
        for n in ORDERS:
            if not len(open_):
                break
            marked = [EDGE + words[i] + EDGE for i in open_]
            sizes = np.fromiter((max(0, len(m) - n + 1) for m in marked), np.int64, len(marked))
            get = self.grams.get
            rows = np.fromiter((get(m[i : i + n], -1) for m in marked for i in range(len(m) - n + 1)), np.int64, sizes.sum())
            owner = np.repeat(np.arange(len(marked)), sizes)[rows >= 0]
            hits = np.bincount(owner, minlength=len(marked))
            done = hits > 0
            for lang in range(out.shape[1]):
                sums = np.bincount(owner, weights=self.logs[rows[rows >= 0], lang], minlength=len(marked))
                out[open_[done], lang] = sums[done] / hits[done]
            open_ = open_[~done]
        return out


def sample(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): blocks of words in the order of a hash, up to ``chars`` characters per language.

    Copies of a text count once per language, and a text of any length gives
    blocks, so every language with a word in its texts is in the sample. A word
    belongs to the block it starts in. A filter by rate keeps about twice the
    bound first, and equal blocks are merged before they are shuffled, so the
    running sum that makes the bound strict never sees a large group.
    """
    block = max(1, min(BLOCK_CHARS, chars // 2))
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.length("text").alias("n"), F.xxhash64("text").alias("h")
    )
    sizes = rows.select("lang", "h", "n").distinct().groupBy("lang").agg(F.sum("n").alias("total"))

    def share(i: Column) -> Column:
        return F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) / float(1 << 30)

    blocks = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))
    near = (
        rows.join(F.broadcast(sizes), "lang")
        .withColumn("i", F.explode(F.filter(blocks, lambda i: share(i) * F.col("total") <= 2 * chars)))
        .select("lang", "h", "i", share(F.col("i")).alias("share"), words_of("text", F.col("i") * block, block).alias("text"))
        .filter(F.col("text").rlike(r"\p{L}"))
        .distinct()
        .withColumn("n", F.length("text"))
    )
    order = Window.partitionBy("lang").orderBy("share", "h", "i", "text").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") <= chars).select("lang", "text")


def words_of(text: str, start: Column, size: int) -> Column:
    """The ``size`` characters of a text from ``start`` (from 0), with whole words only: those that start there.

    Words that do not end in the ``WORD_CHARS`` after the block are cut, and
    blocks inside of such a word are parts of it.
    """
    whole = F.col(text)
    body = F.substring(whole, start + 1, F.lit(size))
    after = F.substring(whole, start + size + 1, F.lit(min(WORD_CHARS, size)))
    inside = F.substring(whole, start, F.lit(1)).rlike(r"^\p{L}") & (start > 0)
    begun = F.when(inside & ~body.rlike(r"^\p{L}+$"), F.regexp_replace(body, r"^\p{L}+", "")).otherwise(body)
    return F.concat(begun, F.when(body.rlike(r"\p{L}$"), F.regexp_extract(after, r"^\p{L}*", 0)).otherwise(F.lit("")))


def fit(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> Model:
    """A model of the languages in ``labelled`` (lang, text), counted by Spark over the sample.

    Its size is bounded by ``chars`` per language, and less of each where languages
    are many (``MODEL_CELLS``). Without labelled rows it knows no language.
    """
    known = labelled.filter("lang is not null").select("lang").distinct().count()
    rows = cut_lineage(sample(labelled, min(chars, max(1, MODEL_CELLS // max(1, known) ** 2))))
    words = cut_lineage(
        rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("item"))
        .groupBy("lang", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    marked = F.concat(F.lit(EDGE), F.col("item"), F.lit(EDGE))
    grams = [
        words.filter(F.length(marked) >= n).select(
            "lang",
            "n",
            F.explode(
                # one parameter: a second would be the place in the list
                F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n)))
            ).alias("item"),
        )
        for n in ORDERS
    ]
    counted = words.select(F.lit(0).alias("kind"), "lang", "item", "n")
    for n, frame in zip(ORDERS, grams):
        counted = counted.unionByName(
            frame.groupBy("lang", "item").agg(F.sum("n").alias("n")).select(F.lit(n).alias("kind"), "lang", "item", "n")
        )
    return of_counts(counted.toArrow())


def of_counts(table: pa.Table) -> Model:
    """The model of counts (kind, lang, item, n); of an n-gram of only a boundary nothing is kept."""
    table = table.filter(pc.not_equal(table["item"], EDGE)).combine_chunks()
    languages = tuple(sorted(pc.unique(table["lang"]).to_pylist()))
    table = table.sort_by([("kind", "ascending"), ("item", "ascending")])
    kind = table["kind"].to_numpy()
    item = table["item"].combine_chunks()
    item = item.chunk(0) if isinstance(item, pa.ChunkedArray) else item
    new = np.ones(len(kind), dtype=bool)
    if len(kind):
        new[1:] = (kind[1:] != kind[:-1]) | pc.not_equal(item.slice(1), item.slice(0, len(item) - 1)).to_numpy(zero_copy_only=False)
    row = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    counts = np.zeros((len(first), len(languages)), dtype=np.float64)
    column = pc.index_in(table["lang"], pa.array(languages, pa.string())).to_numpy()
    counts[row, column] = table["n"].to_numpy()
    kinds, logs = kind[first].astype(np.int8), counts.astype(np.float32)
    for one in np.unique(kinds):
        at = slice(*np.searchsorted(kinds, [one, one + 1]))
        part = counts[at]
        logs[at] = np.log((part + SMOOTH) / (part.sum(axis=0) + SMOOTH * len(part)))
    return Model(languages, item.take(pa.array(first)), kinds, logs)


class Scorer:
    """Scores texts with a bounded memory of words."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 2 * self.width), dtype=np.float32)

    def learn(self, new: list[str]) -> None:
        first, last = len(self.row), len(self.row) + len(new)
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        scores = self.model.scores(new)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        self.table[first:last, : self.width] = scores
        self.table[first:last, self.width :] = odds / odds.sum(axis=1, keepdims=True)
        self.row.update(zip(new, range(first, last)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        tokens = [TOKEN.findall(t.lower()) if t and any(map(str.isalpha, t)) else [] for t in texts]
        if not self.width:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.row) > KEPT:
            self.clear()
        new = set().union(*tokens) - self.row.keys()
        if new:
            self.learn(sorted(new))
        out = []
        for words in tokens:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
            sums = self.table[rows].sum(axis=0, dtype=np.float64)
            best = int(sums[: self.width].argmax())
            out.append((self.model.languages[best], min(1.0, float(sums[self.width + best]) / len(words))))
        return out


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``CHUNK`` characters together."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def detect(text: Column, model: Model, spark) -> Column:
    """struct(lang, score) of a text.

    Null texts and texts without a letter are ``und`` with score 0, as is any
    text under a model without languages. A tie goes to the first language in
    alphabetical order; letters unknown in every language weigh equally for all.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for part in texts:
            rows = [r for some in chunks(part.tolist()) for r in scorer(some)]
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return of(text)
