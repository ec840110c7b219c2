"""Phrases that stick together, mined from all texts of a language.

Pass one keeps, per hash partition of the n-grams, a Misra-Gries summary. Tasks
summarise their texts, summaries of a partition are merged: counts are added, and
if more keys are left than the capacity, the count of the first key too many is
taken from all. A partition's capacity exceeds its mass divided by the threshold,
several times, so what a key loses over all merges stays well below the threshold,
and every n-gram that reaches it survives. What all keys lost is known, and keys
that cannot reach the threshold with it are dropped. Pass two counts the survivors
exactly.

A phrase occurs at most as often as its words and shorter phrases, so the passes
go by size: words are counted, pairs of frequent words are summarised, and longer
phrases only where all their pairs survived. What survived is handed to tasks as
bits of a table of bounded size: a wrong bit costs work and changes nothing, since
everything that passes is counted exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.spread import first_n
from logloom.session import cut_lineage, shuffle_width

UNKNOWN = "und"
LONGEST = 5
LEAST = 100
TOP = 2000
# Bytes of text a task works on at a time
CHUNK = 4 << 20
# How often a partition's capacity exceeds its mass over the threshold
ROOM = 4
# Phrases that a task counts before it passes them on
HELD = 1 << 18
# Keys that a partition's summary may hold; more mass is dealt to more partitions
CAPACITY = 1 << 21
# Bits per survivor of the table that passes them on, and bounds of its size as powers of two
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 20, 28
SLICE = 15
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
BREAK = b"\n"
# [.,;:!?\n\v\f\r] end a piece; tabs separate words as spaces do
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")


def tokens(raw: bytes) -> list[bytes]:
    """The words of joined texts in order, and ``BREAK`` where a piece ends."""
    return [w for w in raw.lower().translate(ENDS).replace(BREAK, b" " + BREAK + b" ").split(b" ") if w]


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by breaks) of about ``size`` bytes; long texts are cut where a piece ends."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            raw = text.as_py()
            if not raw:
                continue
            lang, raw = lang.as_py(), raw.encode("utf-8", "surrogatepass")
            if len(raw) > size:
                yield from ((lang, part) for part in cut(raw, size))
                continue
            held.setdefault(lang, []).append(raw)
            sizes[lang] += len(raw)
            if sizes.total() > size:
                largest = max(sizes, key=sizes.__getitem__)
                yield largest, BREAK.join(held.pop(largest))
                del sizes[largest]
    for lang, some in held.items():
        yield lang, BREAK.join(some)


def cut(raw: bytes, size: int) -> Iterator[bytes]:
    """Parts of a long text: each ends with the first piece that ends ``size`` bytes or more after its start."""
    plain, start = raw.translate(ENDS), 0
    while start < len(raw):
        end = plain.find(BREAK, start + size) + 1
        yield raw[start : end or len(raw)]
        start = end or len(raw)


def word_counts(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(lang, phrase, size, n): every word of ``rows`` (lang, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw in chunks(batches, size):
            found = Counter(tokens(raw))
            del found[BREAK]
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(found), pa.string()), "phrase": texts(found), "n": pa.array(found.values(), pa.int64())}
            )

    part = rows.mapInArrow(of, "lang string, phrase string, n long")
    return part.groupBy("lang", "phrase").agg(F.lit(1).alias("size"), F.sum("n").alias("n"))


def texts(raws) -> pa.Array:
    return pa.array([r.decode("utf-8", "surrogatepass") for r in raws], pa.string())


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a running hash over the number (the finish of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Bits:
    """A set of hashes, as two bits each of a table of ``1 << power`` bits; it may hold more than was put in."""

    def __init__(self, power: int, table: np.ndarray):
        self.power, self.table = power, table

    @staticmethod
    def places(h: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            shift = np.uint64(64 - power)
            return (h >> shift).astype(np.int64), ((h * SECOND) >> shift).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        first, second = self.places(h, self.power)
        found = np.flatnonzero(self.table[first >> 3] >> (first & 7).astype(np.uint8) & 1)
        second = second[found]
        out = np.zeros(len(h), dtype=bool)
        out[found] = self.table[second >> 3] >> (second & 7).astype(np.uint8) & 1
        return out

    @classmethod
    def of(cls, hashes: DataFrame) -> "Bits":
        """From a materialised frame of hashes ``h``. Tasks set the bits of slices of their own; only the
        table, of at most ``1 << MOST_BITS`` bits whatever the frame holds, reaches the driver."""
        n = hashes.count()
        power = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))

        def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(cls.places(batch.column(0).to_numpy().view(np.uint64), power)))
                yield pa.RecordBatch.from_pydict({"slice": pa.array((at >> SLICE).astype(np.int32)), "at": pa.array(at)})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables: dict[int, np.ndarray] = {}
            for batch in batches:
                slices, at = batch.column(0).to_numpy(), batch.column(1).to_numpy() & ((1 << SLICE) - 1)
                for one in np.unique(slices):
                    own = tables.setdefault(int(one), np.zeros(1 << SLICE, dtype=bool))
                    own[at[slices == one]] = True
            for one, own in tables.items():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([one], pa.int32()), "bits": [np.packbits(own, bitorder="little").tobytes()]})

        parts = max(1, min(shuffle_width(hashes.sparkSession), 1 << (power - SLICE)))
        rows = hashes.select("h").mapInArrow(spots, "slice int, at long").repartition(parts, "slice")
        table = np.zeros(1 << (power - 3), dtype=np.uint8)
        for row in rows.mapInArrow(pack, "slice int, bits binary").collect():
            first = row.slice << (SLICE - 3)
            table[first : first + (1 << (SLICE - 3))] = np.frombuffer(bytes(row.bits), np.uint8)
        return cls(power, table)


class Grams:
    """The n-grams of a chunk: hashes by size and where they begin, under filters on words and pairs."""

    def __init__(self, lang: str, raw: bytes, words: Bits, pairs: Bits | None):
        self.tokens = tokens(raw)
        distinct: dict[bytes, int] = {}
        ids = np.fromiter((distinct.setdefault(w, len(distinct)) for w in self.tokens), np.int64, len(self.tokens))
        own = np.fromiter((word_hash(lang, w) for w in distinct), np.uint64, len(distinct))
        open_ = words.holds(own)
        if BREAK in distinct:
            open_[distinct[BREAK]] = False
        self.own, self.open = own[ids], open_[ids]
        self.pairs = pairs

    def __call__(self, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, begins, hashes) for each of ``sizes``, ascending."""
        at = np.flatnonzero(self.open)
        h, paired = self.own[at], None
        with np.errstate(over="ignore"):
            for size in range(2, max(sizes) + 1):
                last = at + size - 1
                more = last < len(self.own)
                at, h, last = at[more], h[more], last[more]
                go = self.open[last] if paired is None else paired[last - 1]
                at, h, last = at[go], h[go], last[go]
                h = h * SPREAD + self.own[last]
                if size == 2 and self.pairs is not None:
                    keep = self.pairs.holds(mixed(h))
                    paired = np.zeros(len(self.own), dtype=bool)
                    paired[at[keep]] = True
                    if 2 in sizes:
                        yield size, at, mixed(h)
                    at, h = at[keep], h[keep]
                elif size in sizes:
                    yield size, at, mixed(h)


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of at most ``capacity`` keys out of summaries laid end to end, and what each count lost at most."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
    lost = 0
    if len(keys) > capacity:
        lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        counts = counts - lost
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts, lost


def survivors(
    rows: DataFrame, words, pairs, sizes: Sequence[int], parts: int, least: int, size: int = CHUNK
) -> DataFrame:
    """(h): hashes of n-grams of ``rows`` (lang, text), among them those of every one found ``least`` times.

    ``words`` and ``pairs`` are broadcast ``Bits`` (``pairs`` may be None). A task
    sends one summary per chunk and hash partition, and its mass ahead of it, so
    that the partition's capacity is known when its summaries are merged.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw in chunks(batches, size):
            grams = Grams(lang, raw, words.value, pairs and pairs.value)
            found = [h for _, _, h in grams(sizes)]
            del grams
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order], counts[order].astype(np.int64), part[order]
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
            if not len(starts):
                continue
            mass, ends = np.add.reduceat(counts, starts), np.append(starts[1:], len(part))
            n, own = len(starts), part[starts].astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.concatenate([own, own])),
                    "kind": pa.array(np.repeat([0, 1], n).astype(np.int32)),
                    "mass": pa.array(np.concatenate([mass, np.zeros(n, np.int64)])),
                    "keys": pa.array([b""] * n + [keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    "counts": pa.array([b""] * n + [counts[a:b].astype(np.uint32).tobytes() for a, b in zip(starts, ends)], pa.binary()),
                }
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mass, lost, keys, counts, waiting, held = None, 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def settle():
            nonlocal keys, counts, lost, waiting, held
            keys, counts, more = merged(
                np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]), ROOM * mass // least + 1
            )
            lost, waiting, held = lost + more, [], 0

        def done() -> pa.RecordBatch:
            settle()
            return pa.RecordBatch.from_pydict({"h": pa.array(keys[counts + lost >= least].view(np.int64))})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for part, kind, own, k, c in zip(*columns):
                if part != at:
                    if at is not None:
                        yield done()
                    at, mass, lost, keys, counts = part, 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind == 0:
                    mass += own
                    continue
                waiting.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64)))
                held += len(waiting[-1][0])
                if held > ROOM * mass // least + (1 << 18):
                    settle()
        if at is not None:
            yield done()

    return (
        rows.mapInArrow(summaries, "part int, kind int, mass long, keys binary, counts binary")
        .repartition(shuffle_width(rows.sparkSession), "part")
        .sortWithinPartitions("part", "kind")
        .mapInArrow(merge, "h long")
    )


def exact_counts(rows: DataFrame, words, pairs, kept, sizes: Sequence[int], size: int = CHUNK) -> DataFrame:
    """(lang, phrase, size, n): exact counts of the n-grams that the broadcast ``kept`` lets through."""
    part = counts_by_task(rows, words, pairs, kept, sizes, size)
    return part.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def counts_by_task(rows: DataFrame, words, pairs, kept, sizes: Sequence[int], size: int = CHUNK) -> DataFrame:
    """The same as each task has counted them, a row per phrase and ``HELD`` phrases that a task has met.

    A frequent phrase is met by most tasks, so there is one task per core, however
    many parts the input has: else rows would grow with phrases times parts.
    """
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Counter] = {}
        for lang, raw in chunks(batches, size):
            grams = Grams(lang, raw, words.value, pairs.value)
            for length, at, h in grams(sizes):
                keep = kept.value.holds(h)
                found = held.setdefault((lang, length), Counter())
                h, at = h[keep], at[keep]
                _, first, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                own = grams.own
                # two phrases of one hash would be counted as one: told apart by what they say
                same = np.ones(len(h), dtype=bool)
                for i in range(length):
                    same &= own[at + i] == own[at[first][back] + i]
                if same.all():
                    for a, n in zip(at[first].tolist(), times.tolist()):
                        found[b" ".join(grams.tokens[a : a + length])] += n
                else:
                    found.update(b" ".join(grams.tokens[a : a + length]) for a in at.tolist())
            if sum(map(len, held.values())) > HELD:
                yield from counted(held)
                held = {}
        yield from counted(held)

    def counted(held: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, length), found in held.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(found), pa.string()),
                    "phrase": texts(found),
                    "size": pa.array([length] * len(found), pa.int32()),
                    "n": pa.array(found.values(), pa.int64()),
                }
            )

    return rows.mapInArrow(of, "lang string, phrase string, size int, n long")


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk: int = CHUNK, capacity: int = CAPACITY
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, n) of all words and phrases found ``least`` times, (lang, n) of all words).

    Phrases have up to ``longest`` words, do not cross the end of a piece, and
    overlap freely. ``docs`` (lang, text): a null language is ``und``, null and
    empty texts hold nothing, rows that repeat count each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter("length(text) > 0")
    counted = cut_lineage(word_counts(rows, chunk))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.filter(F.col("n") >= least)
    if longest < 2:
        return words, totals
    mass = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = shuffle_width(spark)

    def parts(of: int) -> int:
        return max(width, -(-ROOM * of // (least * capacity)))

    def share(hashes: DataFrame):
        return spark.sparkContext.broadcast(Bits.of(hashes))

    word_bits = share(cut_lineage(hashed(words)))
    pair_rows = cut_lineage(survivors(rows, word_bits, None, [2], parts(mass), least, chunk))
    pair_bits = share(pair_rows)
    kept, sizes = pair_rows, range(2, longest + 1)
    if longest > 2:
        more = survivors(rows, word_bits, pair_bits, sizes[1:], parts(mass * (longest - 2)), least, chunk)
        kept = cut_lineage(pair_rows.unionByName(more))
    kept_bits = share(kept)
    phrases = cut_lineage(exact_counts(rows, word_bits, pair_bits, kept_bits, sizes, chunk).filter(F.col("n") >= least))
    for shared in (word_bits, pair_bits, kept_bits):
        shared.destroy()
    return words.unionByName(phrases), totals


def hashed(words: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = np.fromiter((word_hash(lang, w.encode("utf-8", "surrogatepass")) for lang, w in pairs), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"h": pa.array(found.view(np.int64))})

    return words.select("lang", "phrase").mapInArrow(of, "h long")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more, without those a longer one explains.

    A phrase is cut after each of its words; the cut with the lowest
    floor(1000 * a * n / (l * r)) counts, of equal ones the first. Products are
    exact decimals. A phrase goes if some longer one holds it and is as frequent;
    as counts only fall with length, phrases one word longer decide that.
    """
    words = F.split("phrase", " ")
    phrases = frequent.filter("size > 1")
    longer = phrases.filter("size > 2").select(
        "lang",
        F.explode(F.array(F.slice(words, F.lit(1), F.col("size") - 1), F.slice(words, F.lit(2), F.col("size") - 1))).alias("part"),
        F.col("n").alias("of_longer"),
    )
    longer = longer.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("of_longer").alias("of_longer"))
    own = phrases.join(longer, ["lang", "phrase"], "left").filter("of_longer is null or of_longer < n")
    cuts = own.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size", words.alias("w")
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    of_part = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(of_part("first", "l"), ["lang", "first"]).join(of_part("rest", "r"), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})"))
    return cuts.groupBy("lang", "phrase", "a", "n").agg(
        F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chunk: int = CHUNK, capacity: int = CAPACITY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of ``docs`` (lang, text).

    Ordered by score, then frequency, then the phrase's bytes. Only A-Z are
    lower-cased. Other columns are not read; an empty table gives no row.
    """
    frequent, totals = frequent_phrases(docs, least, longest, chunk, capacity)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = first_n(scored(frequent, totals), ["lang"], order, top, ["phrase"])
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
