"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is the vector of how often each group of letters occurs in it. One edit
adds a letter to a group, takes one from a group, or both. The vectors are a
trie, a level per group; a depth-first search follows a word's own counts and may
once take a child with one letter more (the surplus) and, after that, once one
with a letter less (the deficit). Vectors that first differ by a deficit find the
pair from the other side, so each is found once. Words at the leaves reached are
verified letter by letter.

The trie is dealt out by its first levels: a subtree goes to one task, and a word
is sent as a query to the subtrees its budget reaches. A subtree that holds too
many words is dealt to several tasks, each with all of its queries.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import small_if_measured
from logloom.operators.graph import ancestor_chains
from logloom.session import cut_lineage, shuffle_width

# Letter groups, a level of the trie each; letters beyond a-z go to the last two by their code
GROUPS = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "u", "cm", "wfg", "ypb", "vkjxqz")
LEVELS = len(GROUPS) + 2
ALTERED_OF = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
# Words of a subtree that one task holds
SUBTREE = 50_000
# Levels the trie is dealt out by at most: a word is sent to the square of half of them
DEALT_LEVELS = 8
# Steps of the search, and candidate pairs, worked on at a time
FRONT = 1 << 16
PAIRS = 1 << 16
# Letters up to which words are compared as rows of a matrix
SHORT = 32
# Bytes up to which a run's checksum is put together from tables
TABLED = 64
# Characters of texts counted at a time
CHUNK = 4 << 20
# Runs of A-Z, a-z and the letters from U+00C0 to U+00FF, in their one-byte code; all else separates
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def group_table() -> np.ndarray:
    """The level of every one-byte letter."""
    level = np.array([len(GROUPS) + c % 2 for c in range(256)], dtype=np.int64)
    for i, letters in enumerate(GROUPS):
        for letter in letters:
            level[ord(letter)] = i
    return level


GROUP_OF = group_table()


def after(size: int) -> np.ndarray:
    """Tables by byte of what a checksum becomes under ``size`` more bytes, apart from what these say."""
    zeros = bytes(size)
    base = zlib.crc32(zeros, 0)
    bit = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
    table = np.zeros((4, 256), dtype=np.uint32)
    for i in range(32):
        rows = np.arange(256) >> (i % 8) & 1 == 1
        table[i // 8, rows] ^= np.uint32(bit[i])
    return table


class Altered:
    """Counts the runs of texts, some of them with a letter deleted by a checksum of document and run."""

    def __init__(self):
        self.tables = np.stack([after(size) for size in range(TABLED + 1)])

    def __call__(self, docs: list[tuple[object, str]]) -> Counter:
        number: dict[bytes, int] = {}
        ids, owner, start = [], [], []
        for at, (doc, text) in enumerate(docs):
            runs = text.encode("latin-1", "replace").translate(RUNS).split()
            ids.append(np.fromiter((number.setdefault(r, len(number)) for r in runs), np.int64, len(runs)))
            owner.append(np.full(len(runs), at))
            start.append(zlib.crc32(f"{'' if doc is None else doc}:".encode()))
        ids, owner, start = np.concatenate(ids), np.concatenate(owner), np.array(start, dtype=np.uint32)
        runs = list(number)
        encoded = [r if r.isascii() else r.decode("latin-1").encode() for r in runs]
        size = np.array([len(e) for e in encoded], dtype=np.int64)
        letters = np.array([len(r) for r in runs], dtype=np.int64)
        own = np.array([zlib.crc32(e) for e in encoded], dtype=np.uint32)
        h = np.zeros(len(ids), dtype=np.uint32)
        for part in range(0, len(ids), 1 << 18):
            i, first = ids[part : part + (1 << 18)], start[owner[part : part + (1 << 18)]]
            width = np.minimum(size[i], TABLED)
            mark = own[i]
            for byte in range(4):
                mark = mark ^ self.tables[width, byte, (first >> np.uint32(8 * byte)) & np.uint32(255)]
            for j in np.flatnonzero(size[i] > TABLED):
                mark[j] = zlib.crc32(encoded[i[j]], int(first[j]))
            h[part : part + len(i)] = mark
        hit = h % ALTERED_OF == 0
        times = np.bincount(ids[~hit], minlength=len(runs))
        out = Counter({r: n for r, n in zip(runs, times.tolist()) if n})
        for i, mark in zip(ids[hit].tolist(), h[hit].tolist()):
            place = mark % int(letters[i])
            out[runs[i][:place] + runs[i][place + 1 :]] += 1
        return out


def word_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and how often they occur, rare and short ones included.

    Only A-Z are lower-cased. Null and empty texts have no words; a null id counts as an empty one.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, size = Altered(), [], 0

        def counted() -> pa.RecordBatch:
            found = count(held)
            return pa.RecordBatch.from_pydict(
                {"word": pa.array([w.decode("latin-1") for w in found], pa.string()), "n": pa.array(found.values(), pa.int64())}
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                held.append((doc, text))
                size += len(text)
                if size > chunk:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = docs.select("doc_id", "text").mapInArrow(of, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[bytes]) -> np.ndarray:
    """A row of group counts per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(row * LEVELS + GROUP_OF[letters], minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def branch(counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of every row of counts, as a signed number."""
    h = np.full(len(counts), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in counts.T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def reached(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, branches): the subtrees that the budget of each row of counts over the first levels reaches."""
    rows = np.arange(len(counts))
    yield rows, branch(counts)
    for up in range(counts.shape[1]):
        more = counts.copy()
        more[:, up] += 1
        yield rows, branch(more)
        for down in range(up + 1, counts.shape[1]):
            open_ = rows[more[:, down] > 0]
            less = more[open_]
            less[:, down] -= 1
            yield open_, branch(less)


class Trie:
    """Words arranged by successive group counts."""

    def __init__(self, words: list[bytes]):
        counts = vectors(words)
        order = np.lexsort(counts.T[::-1])
        self.words, counts = [words[i] for i in order], counts[order]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(words))
        self.letters = matrix(self.words)
        self.order = order
        # the children of a level: (parent, count) pairs in order; their places are the nodes of the next
        self.base = int(counts.max(initial=0)) + 2
        new = np.zeros(len(words), dtype=bool)
        new[:1] = True
        parent, self.children = np.zeros(len(words), np.int64), []
        for level in range(LEVELS):
            new[1:] |= counts[1:, level] != counts[:-1, level]
            self.children.append((parent * self.base + counts[:, level])[new])
            parent = np.cumsum(new) - 1
        # the words of a leaf are those from first[leaf] to before first[leaf + 1]
        self.first = np.append(np.flatnonzero(new), len(words))

    def leaves(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, whether the vectors are equal) of all leaves in reach, depth first by slices of steps."""
        n = len(counts)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int8))]
        while stack:
            level, query, node, spent = stack.pop()
            if len(query) > FRONT:
                stack += [(level, query[i : i + FRONT], node[i : i + FRONT], spent[i : i + FRONT]) for i in range(0, len(query), FRONT)]
                continue
            if level == LEVELS:
                yield query, node, spent == 0
                continue
            own = counts[query, level]
            up, down = np.flatnonzero(spent == 0), np.flatnonzero((spent == 1) & (own > 0))
            at = np.concatenate([np.arange(len(query)), up, down])
            step = np.repeat(np.array([0, 1, -1]), [len(query), len(up), len(down)])
            want = node[at] * self.base + own[at] + step
            # counts beyond any of the trie would name a child of the next node
            fits = own[at] + step < self.base
            place = np.minimum(np.searchsorted(self.children[level], want), len(self.children[level]) - 1)
            found = (self.children[level][place] == want) & fits
            at = at[found]
            stack.append((level + 1, query[at], place[found], spent[at] + np.abs(step[found]).astype(np.int8)))

    def near(self, queries: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs one edit apart; where vectors are equal, only words greater than the query."""
        letters, sizes = matrix(queries), np.fromiter(map(len, queries), np.int64, len(queries))
        for query, leaf, same in self.leaves(vectors(queries)):
            start = 0
            many = self.first[leaf + 1] - self.first[leaf]
            ends = np.cumsum(many)
            while start < len(query):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS)))
                part = slice(start, stop)
                q = np.repeat(query[part], many[part])
                w = np.arange(len(q)) - np.repeat(np.cumsum(many[part]) - many[part], many[part]) + np.repeat(self.first[leaf[part]], many[part])
                equal = np.repeat(same[part], many[part])
                start = stop
                for a in range(0, len(q), PAIRS):
                    cut = slice(a, a + PAIRS)
                    ok = self.verified(queries, letters, sizes, q[cut], w[cut], equal[cut])
                    if ok.any():
                        yield q[cut][ok], w[cut][ok]

    def verified(self, queries, letters, sizes, q, w, equal) -> np.ndarray:
        """Whether word ``w`` is query ``q`` with one letter replaced, or with one more."""
        n, m = sizes[q], self.sizes[w]
        ok = np.zeros(len(q), dtype=bool)
        short = np.flatnonzero(np.maximum(n, m) <= SHORT)
        a, b = letters[q[short]], self.letters[w[short]]
        differ = a != b
        replaced = (n == m)[short] & (differ.sum(axis=1) == 1)
        # after the first difference all letters of the longer word stand one place later
        place = np.where(differ.any(axis=1), differ.argmax(axis=1), SHORT)
        shifted = (a[:, :-1] == b[:, 1:]) | (np.arange(SHORT - 1) < place[:, None])
        inserted = (n + 1 == m)[short] & shifted.all(axis=1) & ((m[short] < SHORT) | (place < SHORT))
        ok[short] = replaced | inserted
        for i in np.flatnonzero(np.maximum(n, m) > SHORT):
            ok[i] = one_edit(queries[q[i]], self.words[w[i]])
        for i in np.flatnonzero(ok & equal):
            ok[i] = queries[q[i]] < self.words[w[i]]
        return ok


def matrix(words: list[bytes]) -> np.ndarray:
    """The first ``SHORT`` letters of every word, filled up with zeros."""
    return np.array([w[:SHORT] for w in words], dtype=f"S{SHORT}").view(np.uint8).reshape(len(words), SHORT)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether ``b`` is ``a`` with one letter replaced or one more."""
    if len(b) - len(a) not in (0, 1) or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def levels_for(words: DataFrame, most: int) -> int:
    """The fewest first levels, ``DEALT_LEVELS`` at most, whose subtrees hold no more than ``most`` words.

    Counted over all words, one aggregate for every depth at once; a row per depth reaches the driver.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])
            names = [branch(counts[:, :depth]) for depth in range(1, DEALT_LEVELS + 1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "depth": pa.array(np.repeat(np.arange(1, DEALT_LEVELS + 1, dtype=np.int32), len(counts))),
                    "branch": pa.array(np.concatenate(names)),
                }
            )

    sizes = words.select("word").mapInArrow(of, "depth int, branch long").groupBy("depth", "branch").count()
    largest = {r.depth: r.n for r in sizes.groupBy("depth").agg(F.max("count").alias("n")).collect()}
    fits = [depth for depth, n in largest.items() if n <= most]
    return min(fits, default=DEALT_LEVELS if largest else 1)


def pairs(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, near, near_n): every two ``words`` (word, n; each once) one edit apart, in both directions.

    Words are letters up to U+00FF. The first levels of the trie are chosen so that
    a subtree holds ``subtree`` words; one that holds more at ``DEALT_LEVELS`` is dealt
    to several tasks by a hash of its words, and its queries to all of them.
    """
    depth = levels_for(words, subtree)

    def dealt(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            if not own:
                continue
            counts = vectors(own)[:, :depth]
            rows, names = np.arange(len(own)), branch(counts)
            if asking:
                asked = list(reached(counts))
                rows, names = np.concatenate([r for r, _ in asked]), np.concatenate([b for _, b in asked])
                # two subtrees of one name are searched as one, so a word asks there once
                order = np.lexsort([names, rows])
                rows, names = rows[order], names[order]
                new = np.append(True, (rows[1:] != rows[:-1]) | (names[1:] != names[:-1]))
                rows, names = rows[new], names[new]
            yield pa.RecordBatch.from_pydict(
                {
                    "branch": pa.array(names),
                    "query": pa.array(np.full(len(rows), asking, dtype=np.int32)),
                    "word": batch.column(0).take(pa.array(rows)),
                    "n": batch.column(1).take(pa.array(rows)),
                }
            )

    shape = "branch long, query int, word string, n long"
    members, queries = (
        words.select("word", "n").mapInArrow(lambda batches, asking=asking: dealt(batches, asking), shape) for asking in (False, True)
    )
    crowded = cut_lineage(members.groupBy("branch").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > subtree))
    slices = F.coalesce(F.ceil(F.col("held") / subtree), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), slices).cast("int")
    rows = (
        members.unionByName(queries)
        .join(small_if_measured(crowded, 16), "branch", "left")
        .withColumn("slice", F.explode(F.when(F.col("query") == 1, F.sequence(F.lit(0), slices - 1)).otherwise(F.array(own))))
        .drop("held")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, counts, trie = None, [], [], None
        for batch in batches:
            names = list(zip(batch.column("branch").to_pylist(), batch.column("slice").to_pylist()))
            query, word, n = (batch.column(c).to_pylist() for c in ("query", "word", "n"))
            asked: list[int] = []
            for i, name in enumerate(names):
                if name != at:
                    yield from answers(trie, [word[j] for j in asked], [n[j] for j in asked])
                    at, words, counts, trie, asked = name, [], [], None, []
                if not query[i]:
                    words.append(word[i].encode("latin-1"))
                    counts.append(n[i])
                elif words:
                    if trie is None:
                        trie = Trie(words)
                        trie.counts = np.array(counts, dtype=np.int64)[trie.order]
                    asked.append(i)
            yield from answers(trie, [word[j] for j in asked], [n[j] for j in asked])

    def answers(trie: Trie | None, asked: list[str], n: list[int]) -> Iterator[pa.RecordBatch]:
        if trie is None or not asked:
            return
        n = np.array(n, dtype=np.int64)
        for q, w in trie.near([a.encode("latin-1") for a in asked]):
            own, other = [asked[i] for i in q], [trie.words[i].decode("latin-1") for i in w]
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array(own + other, pa.string()),
                    "near": pa.array(other + own, pa.string()),
                    "near_n": pa.array(np.concatenate([trie.counts[w], n[q]])),
                }
            )

    return (
        rows.repartition(shuffle_width(words.sparkSession), "branch", "slice")
        .sortWithinPartitions("branch", "slice", "query")
        .mapInArrow(search, "word string, near string, near_n long")
    )


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, least_letters: int = LEAST_LETTERS, subtree: int = SUBTREE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text).

    Words have ``least_letters`` code points and ``least_count`` occurrences or
    more. A word's form is its near word (one edit away) of most occurrences, of
    equal ones the first in code-point order, if it has at least twice the
    word's; its root is where its forms end. Counts at least double along forms,
    so these have no cycle. Texts that repeat count each; other columns are not
    read; an empty table gives no row.
    """
    words = cut_lineage(
        word_counts(docs).filter((F.col("n") >= least_count) & (F.length("word") >= least_letters))
    )
    best = pairs(words, subtree).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    rows = words.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    leads = F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False))
    rows = cut_lineage(
        rows.select(
            "word",
            F.when(leads, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(leads, F.col("best_n")).alias("form_n"),
        )
    )
    # only words with a form, and the forms themselves, have a chain to follow
    forms = rows.filter("form is not null").select("word", "form")
    ends = forms.select(F.col("form").alias("word")).distinct().join(forms, "word", "left_anti")
    links = forms.unionByName(ends.withColumn("form", F.lit(None).cast("string")))
    roots = ancestor_chains(links, "word", "form").select(F.col("node").alias("word"), F.col("last").alias("root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
