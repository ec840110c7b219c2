"""Benchmark passages in documents, by the q-gram lemma.

Texts are folded to their letters and digits in lower case, so layout and
punctuation do not count. An occurrence of a passage of m letters with at most k
edits shares m - q + 1 - k * q of its q-grams with it, on diagonals no more than
k apart. Shared q-grams are counted in overlapping bands of diagonals; bands that
reach that number are regions, and a banded alignment of the whole passage
within the region verifies the edits and finds where occurrences begin and end.
Short passages have shorter q-grams, so that the number is never below one.

Of the places where a passage ends with at most k edits, every exact one is an
occurrence; another is one unless a place nearby accounts for it: one with fewer
edits, or as many and earlier, whose edits and distance are together no more than
its own edits and one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import cut_lineage

Q = 8
# Edits allowed per letter of the passage
EDITS = 0.08
# Letters below which a passage is no evidence, unless asked for
LEAST = 8
# Diagonals per band, before its overlap with the next
BAND = 32
# Benchmark letters that one pass over the documents looks for: bounds what is broadcast
BLOCK = 4 << 20
# Document letters searched at a time
CHUNK = 1 << 21
# Shared q-grams worked on at a time
HITS = 1 << 20
# Passages from which on a q-gram is common
COMMON = 64
# Regions aligned at a time, and letters of their windows together
ALIGNED = 256
WINDOWS = 1 << 20
BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def fold(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters and digits in lower case, and where they stand in the text."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = np.flatnonzero(letters()[points])
    return points[at], at


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of every q-gram."""
    with np.errstate(over="ignore"):
        one = points.astype(np.uint64) + np.uint64(1)
        h, base, size = one, BASE, 1
        for bit in f"{q:b}"[1:]:
            h = h[: max(0, len(h) - size)] * base + h[size:]
            base, size = base * base, 2 * size
            if bit == "1":
                h = h[: max(0, len(h) - 1)] * BASE + one[size:]
                base, size = base * BASE, size + 1
        return h ^ (h >> np.uint64(29))


class Table:
    """The q-grams of those passages of an index that go by one q.

    Common q-grams are left out of a passage that has enough others: at most as
    many as it may miss besides its edits, so that one of the rest is still shared.
    """

    def __init__(self, q: int, items: np.ndarray, points: list[np.ndarray], needed: np.ndarray):
        self.q, self.items = q, items
        marks = [grams(points[i], q) for i in items]
        owner = np.repeat(np.arange(len(items)), [len(m) for m in marks])
        place = np.concatenate([np.arange(len(m)) for m in marks])
        marks = np.concatenate(marks)
        _, back, times = np.unique(marks, return_inverse=True, return_counts=True)
        common = times[back] > COMMON
        n_common = np.bincount(owner[common], minlength=len(items))
        spare = n_common < needed[items]
        self.needed = needed[items] - np.where(spare, n_common, 0)
        stays = ~(common & spare[owner])
        marks, owner, place = marks[stays], owner[stays], place[stays]
        order = np.lexsort([owner, marks])
        self.owner, self.place = owner[order], place[order]
        self.marks, which = np.unique(marks[order], return_inverse=True)
        # entries by q-gram and owner in one ascending number
        self.entry = which * len(items) + self.owner
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[(self.marks >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, q-gram) wherever a known q-gram stands."""
        h = grams(joined, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        which = np.searchsorted(self.marks, h[at])
        which[which == len(self.marks)] = 0
        real = self.marks[which] == h[at]
        return at[real], which[real]

    def spans(self, which: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of each q-gram begin and end that belong to the owners from first to before last."""
        n = len(self.items)
        return np.searchsorted(self.entry, which * n + first), np.searchsorted(self.entry, which * n + last)


class Index:
    """The q-grams of a block of passages (item_id, text) of ``least`` letters or more."""

    def __init__(self, items: list[tuple[int, str | None]], edits: float = EDITS, least: int = LEAST):
        folded = [(i, fold(t)[0]) for i, t in items]
        folded = [(i, p) for i, p in folded if len(p) >= max(1, least)]
        self.ids = [i for i, _ in folded]
        self.points = [p for _, p in folded]
        self.sizes = np.array([len(p) for p in self.points], dtype=np.int64)
        self.budget = np.floor(self.sizes * min(edits, 1 / Q)).astype(np.int64)
        q = np.minimum(Q, self.sizes // (self.budget + 1))
        needed = self.sizes - q + 1 - self.budget * q
        self.longest = int(self.sizes.max(initial=0))
        self.tables = [Table(int(one), np.flatnonzero(q == one), self.points, needed) for one in np.unique(q)]

    def regions(self, docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc, item, first diagonal of the band) where enough q-grams are shared, in parts.

        A diagonal is the place in the document less that in the passage, plus ``longest``.
        """
        if not docs:
            return
        sizes = np.array([len(d) for d in docs])
        # zeros between documents: no q-gram of a passage holds one
        joined = np.concatenate([x for d in docs for x in (d, np.zeros(Q, d.dtype))])
        begins = np.concatenate(([0], np.cumsum(sizes + Q)[:-1]))
        bands = (int(sizes.max()) + 2 * self.longest) // BAND + 2
        for table in self.tables:
            at, which = table.hits(joined)
            doc = np.searchsorted(begins, at, side="right") - 1
            at = at - begins[doc]
            stack = [(0, len(table.items))] if len(at) else []
            while stack:
                first, last = stack.pop()
                low, high = table.spans(which, first, last)
                ends = np.cumsum(high - low)
                if ends[-1] > HITS and last - first > 1:
                    # too many at once: the passages by halves
                    middle = (first + last) // 2
                    stack += [(middle, last), (first, middle)]
                    continue
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for start in range(0, int(ends[-1]), HITS):
                    line = np.arange(start, min(start + HITS, int(ends[-1])))
                    row = np.searchsorted(ends, line, side="right")
                    entry = high[row] - (ends[row] - line)
                    part = self.bands_of(table, doc[row], at[row], entry, bands)
                    keys, back = np.unique(np.concatenate([keys, part]), return_inverse=True)
                    counts = np.bincount(back, weights=np.concatenate([counts, np.ones(len(part), np.int64)])).astype(np.int64)
                own = keys // bands % len(table.items)
                keep = counts >= table.needed[own]
                if keep.any():
                    keys, own = keys[keep], own[keep]
                    yield keys // bands // len(table.items), table.items[own], keys % bands * BAND

    def bands_of(self, table: Table, doc: np.ndarray, at: np.ndarray, entry: np.ndarray, bands: int) -> np.ndarray:
        """The bands each shared q-gram counts for, as numbers of document, owner and band."""
        owner = table.owner[entry]
        diagonal = at - table.place[entry] + self.longest
        keys = (doc * len(table.items) + owner) * bands + diagonal // BAND
        # a band reaches its item's budget into the next ones
        into, budget = diagonal % BAND, self.budget[table.items[owner]]
        more, back = [keys], 1
        while True:
            reach = (into + (back - 1) * BAND < budget) & (diagonal // BAND >= back)
            if not reach.any():
                return np.concatenate(more)
            more.append(keys[reach] - back)
            back += 1

    def aligned(self, docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray):
        """(region, edits, start, end) in the folded document of all ends within the budget of each region.

        The whole passage against any part of the document, within the region's
        diagonals widened by the budget on both sides. All regions advance a letter
        of their passages together; a cell is cost and start in one number.
        Regions without a cell left within the budget are dropped on the way.
        """
        budget = self.budget[item]
        spread = int(budget.max(initial=0))
        width = BAND + 3 * spread + 1
        low = diagonal - self.longest - spread
        lane = np.arange(width)
        shift = np.int64(1) << 24
        far = shift << 24
        rows = int(self.sizes[item].max())
        # places outside of the document match nothing
        window = np.zeros((len(doc), rows + width), dtype=np.int64)
        text = np.full((len(doc), rows), -1, dtype=np.int64)
        for r, (d, i, s) in enumerate(zip(doc, item, low)):
            a, b = max(0, s), min(len(docs[d]), s + rows + width)
            if b > a:
                window[r, a - s : b - s] = docs[d][a:b]
            text[r, : self.sizes[i]] = self.points[i]
        # cell (row, lane) ends at window place row + lane; before the first letter any start is free
        cells = np.broadcast_to(lane.astype(np.int64), (len(doc), width)).copy()
        region, size = np.arange(len(doc)), self.sizes[item]
        for j in range(rows):
            live = (j < size)[:, None]
            same = window[:, j : j + width] == text[:, j : j + 1]
            step = cells + np.where(same, 0, shift)
            skip = np.concatenate([cells[:, 1:], np.full((len(region), 1), far)], axis=1) + shift
            new = np.minimum(step, skip)
            new = np.minimum.accumulate(new - lane * shift, axis=1) + lane * shift
            cells = np.where(live, new, cells)
            if j % 16 == 15:
                open_ = cells.min(axis=1) // shift <= budget
                if not open_.any():
                    region = region[:0]
                    cells = cells[:0]
                    break
                if open_.mean() < 0.75:
                    cells, window, text, region, size, budget = (x[open_] for x in (cells, window, text, region, size, budget))
        r, at = np.nonzero(cells // shift <= budget[:len(cells), None])
        value = cells[r, at]
        return region[r], value // shift, low[region[r]] + value % shift, low[region[r]] + at + size[r]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every passage found; code points, end exclusive."""
        folded = [fold(t) for t in texts]
        docs = [p for p, _ in folded]
        found = []
        for doc, item, diagonal in self.regions(docs):
            order = np.argsort(self.sizes[item], kind="stable")
            at = 0
            while at < len(order):
                # those of the largest passage decide how many fit
                some = order[at : at + ALIGNED]
                one = self.sizes[item[some]] + BAND + 3 * self.budget[item[some]]
                fits = max(1, int(np.searchsorted(one * np.arange(1, len(some) + 1), WINDOWS, side="right")))
                some = some[:fits]
                at += len(some)
                r, cost, start, end = self.aligned(docs, doc[some], item[some], diagonal[some])
                found.append(np.stack([doc[some][r], item[some][r], end, cost, start]))
        if not found:
            return []
        sizes = np.array([len(d) for d in docs])
        out = []
        for row, item, end, cost, start in occurrences(np.concatenate(found, axis=1), sizes, self.budget).T.tolist():
            place = folded[row][1]
            out.append((row, item, int(place[start]), int(place[end - 1]) + 1, cost))
        return sorted(out)


def occurrences(ends: np.ndarray, sizes: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Columns (doc, item, end, edits, start) of the occurrences among all ends within the budgets."""
    doc, item, end, cost, start = ends
    end, start = np.minimum(end, sizes[doc]), np.maximum(start, 0)
    order = np.lexsort([start, cost, end, item, doc])
    doc, item, end, cost, start = (x[order] for x in (doc, item, end, cost, start))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (end[1:] != end[:-1])
    new &= start < end
    doc, item, end, cost, start = (x[new] for x in (doc, item, end, cost, start))
    explained = np.zeros(len(doc), dtype=bool)
    for gap in range(1, min(int(budget.max(initial=0)) + 2, len(doc))):
        a, b = slice(None, -gap), slice(gap, None)
        away = end[b] - end[a]
        same = (doc[a] == doc[b]) & (item[a] == item[b])
        if not (same & (away <= budget[item[a]] + 1)).any():
            break
        explained[a] |= same & (cost[b] < cost[a]) & (cost[b] + away <= cost[a] + 1)
        explained[b] |= same & (cost[a] <= cost[b]) & (cost[a] + away <= cost[b] + 1)
    keep = ~explained | (cost == 0)
    return np.stack([x[keep] for x in (doc, item, end, cost, start)])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts): consecutive texts of about ``CHUNK`` characters together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def n_blocks(benchmark: DataFrame, letters_each: int = BLOCK) -> int:
    return max(1, -(-benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // letters_each))


def blocks(benchmark: DataFrame, edits: float, letters_each: int = BLOCK, least: int = LEAST) -> Iterator[Index]:
    """The benchmark in parts of about ``letters_each`` characters, each a bounded index."""
    items = benchmark.select(F.col("item_id"), "text").filter("text is not null")
    parts = n_blocks(items, letters_each)
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Index([(r.item_id, r.text) for r in rows], edits, least)


def passages(
    docs: DataFrame,
    benchmark: DataFrame,
    edits: float = EDITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    letters_each: int = BLOCK,
) -> DataFrame:
    """(id, item_id, start, end, edits): every occurrence of a ``benchmark`` (item_id, text) passage.

    An occurrence is the whole passage with at most ``edits`` per letter of it, be
    it beside or across another one; of starts with as few edits the first counts.
    Null and empty texts hold none; passages of fewer than ``least`` letters are
    not looked for; equal passages under several ids are each reported, as are
    rows of ``docs`` that repeat. The benchmark is searched for block by block of
    ``letters_each`` characters; a task holds one of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    out = None
    for index in blocks(benchmark, edits, letters_each, least):
        shared = spark.sparkContext.broadcast(index)

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for first, some in chunks(texts):
                    found = index.search(some)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": pa.array([ids[first + r] for r, *_ in found], pa.int64()),
                            "item_id": pa.array([index.ids[i] for _, i, *_ in found], pa.int64()),
                            "start": pa.array([f[2] for f in found], pa.int64()),
                            "end": pa.array([f[3] for f in found], pa.int64()),
                            "edits": pa.array([f[4] for f in found], pa.int32()),
                        }
                    )

        part = rows.mapInArrow(of, "id long, item_id long, start long, end long, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text") -> Column:
    """Whether a text holds a passage, as a column of ``docs``: for a benchmark of one block.

    A larger one is worked off by ``without_passages``.
    """
    if n_blocks(benchmark) > 1:
        raise ValueError("more than one block of passages: use without_passages")
    return holds_one_of(next(blocks(benchmark, edits)), docs, text_col)


def holds_one_of(index: Index, docs: DataFrame, text_col: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, hit = part.tolist(), np.zeros(len(part), dtype=bool)
            for first, some in chunks(texts):
                hit[[first + r for r, *_ in shared.value.search(some)]] = True
            yield pd.Series(hit)

    return of(F.col(text_col))


def without_passages(
    docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text", letters_each: int = BLOCK
) -> DataFrame:
    """The rows of ``docs`` whose texts hold no passage. One block of the benchmark per pass, so that a
    worker holds one; what a pass keeps is written before the next."""
    parts = n_blocks(benchmark, letters_each)
    for n, index in enumerate(blocks(benchmark, edits, letters_each), 1):
        docs = docs.filter(~holds_one_of(index, docs, text_col))
        if n < parts:
            docs = cut_lineage(docs)
    return docs
