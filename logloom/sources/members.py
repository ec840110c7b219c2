"""Members of JSON documents of any size, read in byte ranges.

Spark reads a document as records between commas, each split of a file by itself,
so no row and no task holds a document. The task that reads a split puts its
records together again to slices of bounded size, and later steps pass a row per
slice. How many quotes and brackets a record has says where strings and levels
begin and end; sums over the slices before one tell at which of its commas a
member ends. Whether a slice begins inside a string is known only from the slices
before it, so its brackets are counted for either case. Members inside a slice
are read where it lies; only those that are cut by its ends are put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.session import cut_lineage

PLACE = ["path", "block", "id"]
# Bytes of a slice; one record may be longer
SLICE = 1 << 20
# Rows about slices or documents up to which they are broadcast
FEW = 100_000
# Rows about slices, and bytes of members, that a task passes on at a time
TOGETHER = 4096
BATCH = 4 << 20
LISTED = re.compile(rb"\s*\[")
AT_ONCE = re.compile(rb'\s*\{\s*"attributes"\s*:\s*([\[{])')
LATER = re.compile(rb'(?:\A|,)\s*"attributes"\s*:\s*([\[{])')
HEADS = {1: LISTED, 2: re.compile(rb'\s*\{?\s*"attributes"\s*:\s*[\[{]')}
# closing brackets at the end, which Unicode's line ends may follow
TAIL = rb"(?=(?:\xc2\x85|\xe2\x80[\xa8\xa9])?\Z)"
ONE, TWO = re.compile(rb"\s*[\]}]\s*" + TAIL), re.compile(rb"\s*[\]}]\s*\}\s*" + TAIL)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, id, text): the text between two commas, in order by block and id."""
    return (
        spark.read.option("lineSep", ",")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            F.col("value").alias("text"),
        )
    )


class Records:
    """The records of a slice: where each ends, and the level and whether no string is open before and after it."""

    def __init__(self, raw: bytes, quoted: int, start: int):
        self.raw = raw
        self.ends, quotes, spots, change = structure(raw)
        inside = (np.searchsorted(quotes, spots) + quoted) % 2 == 0
        levels = np.concatenate(([start], start + np.cumsum(change[inside])))
        self.level = levels[np.searchsorted(spots[inside], self.ends)]
        self.outside = (np.searchsorted(quotes, self.ends) + quoted) % 2 == 0
        self.was = np.concatenate(([start], self.level[:-1]))
        self.was_outside = np.concatenate(([quoted % 2 == 0], self.outside[:-1]))
        self.begins = np.concatenate(([0], self.ends[:-1] + 1))

    def later(self) -> tuple[int, str] | None:
        """The first record that opens ``attributes`` in an object that is the document, and as what."""
        for found in LATER.finditer(self.raw):
            at = int(np.searchsorted(self.ends, found.start() + (found.group()[:1] == b",")))
            if self.was[at] == 1 and self.was_outside[at]:
                return at, found[1].decode()
        return None

    def kept(self, deep: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """The records of members, from ``begin`` on (before 0: in a slice before), and whether a member ends with each."""
        # after the comma at a lower level the body is over
        at = np.arange(max(begin, 0), len(self.ends))
        at = at[(self.was[at] >= deep) | (at == begin)]
        return at, (self.level[at] == deep) & self.outside[at]

    def text(self, at: int, deep: int, begin: int) -> bytes:
        """A record without the brackets around all members."""
        raw = self.raw[self.begins[at] : self.ends[at]]
        if deep == 0:
            return raw
        if at == begin:
            raw = HEADS[deep].sub(b"", raw, count=1) if HEADS[deep].match(raw) else raw
        if self.level[at] >= deep or not self.outside[at]:
            return raw
        # what follows the last member are closing brackets, one for each level that is left
        return (TWO if self.level[at] == 0 and deep == 2 else ONE).sub(b"", raw)

    def members(self, deep: int, begin: int, whole: bool) -> Iterator[tuple[int, bytes]]:
        """(number of ends before, text) of the members that lie in the slice, or of the parts of others at its ends."""
        at, ends = self.kept(deep, begin)
        if not len(at):
            return
        number = np.cumsum(ends) - ends if deep else np.zeros(len(at), np.int64)
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        last = np.append(first[1:], len(at)) - 1
        inside = ends[last] if deep else np.zeros(len(last), bool)
        inside[0] &= begin >= 0
        # a run of records without brackets to take off is a part of the text as it is
        odd = (at == begin) | ((self.level[at] < deep) & self.outside[at])
        plain = (np.add.reduceat(odd, first, dtype=np.int64) == 0) & (at[last] - at[first] == last - first)
        mine = np.flatnonzero(inside == whole)
        starts, stops = self.begins[at[first]], self.ends[at[last]]
        for k, n, simple, a, b in zip(mine.tolist(), number[first[mine]].tolist(), plain[mine].tolist(), starts[mine].tolist(), stops[mine].tolist()):
            if simple:
                yield n, self.raw[a:b]
            else:
                yield n, b",".join(self.text(i, deep, begin) for i in at[first[k] : last[k] + 1].tolist())


def structure(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of records, places of quotes, and of brackets with by how much each changes the level."""
    text = np.frombuffer(raw, np.uint8)
    kinds = KINDS[text]
    spots = np.flatnonzero(kinds)
    kinds = kinds[spots]
    ends = np.append(spots[kinds == COMMA], len(text))
    if (kinds == ESCAPE).any():
        # after an odd number of backslashes a sign stands for itself; a comma ends a record nevertheless
        at = spots[kinds == ESCAPE]
        head = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        size = np.diff(np.append(head, len(at)))
        escaped = (at[head] + size)[size % 2 == 1]
        left = ~np.isin(spots, escaped, assume_unique=True)
        spots, kinds = spots[left], kinds[left]
    bracket = (kinds == OPEN) | (kinds == CLOSE)
    return ends, spots[kinds == QUOTE], spots[bracket], np.where(kinds[bracket] == OPEN, 1, -1)


QUOTE, OPEN, CLOSE, COMMA, ESCAPE = range(1, 6)
KINDS = np.zeros(256, np.uint8)
for _sign, _kind in {'"': QUOTE, "[": OPEN, "{": OPEN, "]": CLOSE, "}": CLOSE, ",": COMMA, "\\": ESCAPE}.items():
    KINDS[ord(_sign)] = _kind


def slices(rows: DataFrame, size: int) -> DataFrame:
    """(path, block, id, raw, quotes, level_0, level_1): neighbouring records of a split as one text, ``id`` that of the first.

    ``level_0`` is by how much brackets outside strings change the level if the
    slice begins outside a string, ``level_1`` if inside. A task reads a split in order.
    """

    def one(path: str, block: int, first: int, parts: list[bytes]) -> pa.RecordBatch:
        raw = b",".join(parts)
        _, quotes, spots, change = structure(raw)
        odd = np.searchsorted(quotes, spots) % 2
        levels = [int(change[odd == k].sum()) for k in (0, 1)]
        return pa.RecordBatch.from_pydict(
            {"path": [path], "block": [block], "id": [first], "raw": [raw], "quotes": [len(quotes)], "level_0": [levels[0]], "level_1": [levels[1]]}
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, parts, held = None, 0, [], 0
        for path, block, ids, texts in runs(batches):
            if (path, block) != at:
                if parts:
                    yield one(*at, first, parts)
                at, parts, held = (path, block), [], 0
            sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
            a = 0
            while a < len(texts):
                before = sizes[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(sizes, before + size - held, "right")))
                first = first if parts else ids[a].as_py()
                parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), texts[a:b]), b",")[0].as_py())
                held += int(sizes[b - 1] - before)
                if b < len(texts) or held >= size:
                    yield one(*at, first, parts)
                    parts, held = [], 0
                a = b
        if parts:
            yield one(*at, first, parts)

    return rows.select(*PLACE, F.col("text").cast("binary").alias("text")).mapInArrow(
        of, "path string, block long, id long, raw binary, quotes long, level_0 long, level_1 long"
    )


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, pa.Array]]:
    """(path, block, ids, texts) of neighbouring records of a split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks, ids, texts = (batch.column(k) for k in range(4))
        cuts = [0, batch.num_rows]
        # a split is read once, so if its ends are of one split all of the batch is
        if paths[0] != paths[-1] or blocks[0] != blocks[-1]:
            other = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
            cuts[1:1] = (np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield paths[a].as_py(), blocks[a].as_py(), ids[a:b], texts[a:b]


def _before(column) -> Column:
    """Sum over the slices before this one; a document has as many rows here as slices."""
    window = Window.partitionBy("path").orderBy("block", "id").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _beside(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Slices with what is known of each or of its document; texts are not shuffled while that is little."""
    small = cut_lineage(small)
    return rows.join(F.broadcast(small) if small.count() <= FEW else small, on)


def levels(rows: DataFrame) -> DataFrame:
    """(path, block, id, raw, quoted, start): whether a string is open where a slice begins, and the level there."""
    totals = rows.select(*PLACE, "quotes", "level_0", "level_1").withColumn("quoted", _before("quotes") % 2)
    change = F.when(F.col("quoted") == 0, F.col("level_0")).otherwise(F.col("level_1"))
    starts = totals.select(*PLACE, "quoted", _before(change).alias("start"))
    return _beside(rows.select(*PLACE, "raw"), starts, PLACE)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice what tells its document's form."""

    def facts(path, block, first, raw, quoted, start) -> dict:
        rows = Records(raw, quoted, start)
        at_once, later = AT_ONCE.match(raw), rows.later()
        return {
            "path": path, "block": block, "id": first,
            "listed": LISTED.match(raw) is not None, "at_once": at_once[1].decode() if at_once else "",
            "later": later and later[0], "form": later and later[1],
            "least": int(rows.level.min()), "end": int(rows.level[-1]), "closed": bool(rows.outside[-1]),
        }

    yield from _collected(batches, facts, pa.schema(
        [("path", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("listed", pa.bool_()), ("at_once", pa.string()),
         ("later", pa.int64()), ("form", pa.string()), ("least", pa.int64()), ("end", pa.int64()), ("closed", pa.bool_())]
    ))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many members end in each slice."""

    def ends(path, block, first, raw, quoted, start, deep, begin) -> dict:
        return {"path": path, "block": block, "id": first, "ends": int(Records(raw, quoted, start).kept(deep, begin)[1].sum())}

    yield from _collected(batches, ends, pa.schema([("path", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("ends", pa.int64())]))


def _collected(batches: Iterator[pa.RecordBatch], of: Callable[..., dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = []
    for batch in batches:
        for row in zip(*batch.columns):
            out.append(of(*(x.as_py() for x in row)))
            if len(out) >= TOGETHER:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def _texts(rows: DataFrame, whole: bool) -> DataFrame:
    """(path, block, id, place, _keyed, _deep, text) of the members inside the slices, or of the parts of the others."""

    def batch(path, block, first, keyed, deep, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(found)
        columns = {"path": pa.array([path] * n, pa.string()), "block": pa.array([block] * n, pa.int64()), "id": pa.array([first] * n, pa.int64())}
        columns |= {"place": pa.array([p for p, _ in found], pa.int64()), "_keyed": pa.array([keyed] * n, pa.bool_())}
        return pa.RecordBatch.from_pydict(columns | {"_deep": pa.array([deep] * n, pa.int32()), "raw": pa.array([t for _, t in found], pa.binary())})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in zip(*some.columns):
                path, block, first, raw, quoted, start, deep, begin, keyed, before = (x.as_py() for x in row)
                found, size = [], 0
                for number, text in Records(raw, quoted, start).members(deep, begin, whole):
                    found.append((before + number if deep else 0, text))
                    size += len(text)
                    if size >= BATCH:
                        yield batch(path, block, first, keyed, deep, found)
                        found, size = [], 0
                yield batch(path, block, first, keyed, deep, found)

    out = rows.mapInArrow(of, "path string, block long, id long, place long, _keyed boolean, _deep int, raw binary")
    return out.withColumn("text", F.col("raw").cast("string")).drop("raw")


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, key, json): members of the documents below ``path`` as :func:`catalogue.entries` gives them.

    A document is a list, an object with ``attributes`` (a list or an object; the first of that name counts), or one
    entry by itself, which is a member whole. A member has to fit into a row, a
    document does not. Documents with more brackets opened than closed, or an
    open string at the end, have no members; a member of several that is no JSON has null for ``json``. A document inside a
    string is one string here: such documents go through :func:`catalogue.documents`.
    """
    rows = levels(cut_lineage(slices(records(spark, path), SLICE)))
    spot = F.struct("block", "id")
    facts = cut_lineage(rows.mapInArrow(
        _facts, "path string, block long, id long, listed boolean, at_once string, later long, form string, least long, end long, closed boolean"
    ))
    first = facts.groupBy("path").agg(
        F.min(F.struct("block", "id", F.lit(0).cast("bigint").alias("row"))).alias("_first"),
        F.min_by(F.when(F.col("listed"), F.lit("[")).otherwise(F.col("at_once")), spot).alias("_at_once"),
        F.min_by("listed", spot).alias("_list"),
        F.min(F.when(F.col("later").isNotNull(), F.struct("block", "id", F.col("later").alias("row"), "form"))).alias("_later"),
        F.min("least").alias("_least"),
        F.max_by("end", spot).alias("_end"),
        F.max_by("closed", spot).alias("_closed"),
    )
    direct = F.col("_at_once") != ""
    later = ~direct & F.col("_later").isNotNull()
    forms = first.filter("_least >= 0 and _end = 0 and _closed").select(
        "path",
        F.when(later & ~F.col("_list"), F.struct("_later.block", "_later.id", "_later.row")).otherwise(F.col("_first")).alias("_begin"),
        # the level of members, and whether they have keys
        F.when(F.col("_list"), 1).when(direct | later, 2).otherwise(0).alias("_deep"),
        (F.when(direct, F.col("_at_once")).otherwise(F.col("_later.form")) == "{").alias("_keyed"),
    )
    begin = F.struct("_begin.block", "_begin.id")
    inside = _beside(rows, forms, ["path"]).filter(spot >= begin)
    inside = inside.withColumn("_row", F.when(spot == begin, F.col("_begin.row")).otherwise(-1))
    ends = inside.select(*PLACE, "raw", "quoted", "start", "_deep", "_row").mapInArrow(_ends, "path string, block long, id long, ends long")
    counts = cut_lineage(ends).select(*PLACE, _before("ends").alias("_members"))
    numbered = _beside(inside, counts, PLACE).select(*PLACE, "raw", "quoted", "start", "_deep", "_row", "_keyed", "_members")
    parts = (
        _texts(numbered, False)
        .groupBy("path", "place", "_keyed", "_deep")
        .agg(F.array_sort(F.collect_list(F.struct("block", "id", "text"))).alias("_parts"))
        .withColumn("text", F.array_join(F.col("_parts.text"), ","))
    )
    fields = ["path", "place", "_keyed", "_deep", "text"]
    joined = _texts(numbered, True).select(*fields).unionByName(parts.select(*fields))
    joined = joined.filter(F.trim(F.regexp_replace("text", r"\s", " ")) != "")
    keyed = F.coalesce(F.col("_keyed"), F.lit(False)) & (F.col("_deep") == 2)
    pair = F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>"))
    item = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")
    return joined.select(
        "path",
        F.struct("path", F.col("place").cast("bigint").alias("place")).alias("pos"),
        F.when(keyed, F.get(pair, F.lit(0))["key"]).alias("key"),
        F.when(F.col("_deep") == 0, F.col("text")).when(keyed, F.get(pair, F.lit(0))["value"]).otherwise(F.get(item, F.lit(0))).alias("json"),
    )
