"""Token counts of whole texts under a byte-level BPE vocabulary.

Each document becomes its pre-tokens and their frequencies; a distinct
pre-token's pieces are counted once, joined to the frequencies and summed, and
no token ids are made. To keep the joined rows few, documents are taken in blocks:
a row holds a pre-token and where in its block it occurs how often, packed.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import shuffle_width

# How byte-level BPE vocabularies of this family split text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A block ends with the document that brings it to this many (document, pre-token) pairs or documents
PAIRS = 3 << 20
DOCUMENTS = 60_000
# Bits of a count of one unit in one text; a larger count takes several entries
COUNT_BITS = 24
# Units a task holds before it passes their pre-tokens on
UNITS = 250_000
# Sums a task holds before it passes them on
SUMS = 8 << 20


# A space between two characters that are none: what follows is split apart from what precedes
BREAK = re.compile(r"(?<=\S) (?=\S)")


class Splitter:
    """Splits text into the pre-tokens of a tokenizer file; its special strings are pre-tokens of their own.

    Text is first cut into units at single spaces, before which every match of the
    pattern ends; the pattern then runs once per distinct unit.
    """

    def __init__(self, spec: str):
        told = json.loads(spec)
        kind = told["pre_tokenizer"]
        added = told["added_tokens"]
        plain = (
            kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]
            and told["normalizer"] is None and told["post_processor"] is None
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError("only plain byte-level tokenizers are supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = frozenset(names)
        self.pieces = regex.compile(PATTERN)

    def units(self, text: str) -> tuple[list[str], list[str]]:
        """The text in parts that are split apart from each other; of the second list a space precedes each."""
        if self.special is None or not self.special.search(text):
            first, *rest = BREAK.split(text)
            return [first], rest
        plain, spaced = [], []
        for part in self.special.split(text):
            first, *rest = [part] if part in self.names else BREAK.split(part)
            plain.append(first)
            spaced += rest
        return plain, spaced

    def pre_tokens(self, unit: str, space: str = "") -> list[str]:
        return [unit] if unit in self.names and not space else self.pieces.findall(space + unit)


def packed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of 2 bytes of place and 1 byte of count, and how many each pair takes: a count over 255 takes several."""
    times = np.maximum(1, (n + 254) // 255)
    last = np.cumsum(times) - 1
    out = np.empty((int(times.sum()), 3), dtype=np.uint8)
    at, each = np.repeat(at, times), np.full(len(out), 255, dtype=np.int64)
    each[last] = n - (times - 1) * 255
    out[:, 0], out[:, 1], out[:, 2] = at & 255, at >> 8, each
    return out, times


def split_counts(unit: np.ndarray, owner: np.ndarray, count: np.ndarray, bits: int = COUNT_BITS):
    """The entries with counts of more than ``bits`` bits as several."""
    most = (1 << bits) - 1
    if not len(count) or count.max() <= most:
        return unit, owner, count
    times = -(-count // most)
    each = np.full(int(times.sum()), most, dtype=count.dtype)
    each[np.cumsum(times) - 1] = count - (times - 1) * most
    return np.repeat(unit, times), np.repeat(owner, times), each


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))


def vocabulary(docs: DataFrame, spec: str, id_col: str, text_col: str) -> DataFrame:
    """(word): the distinct pre-tokens of all texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(spec)
        units: set[str] = set()
        firsts: set[str] = set()

        def words() -> pa.RecordBatch:
            found = {w for u in units for w in split.pre_tokens(u, " ")} | {w for u in firsts for w in split.pre_tokens(u)}
            return pa.RecordBatch.from_pydict({"word": pa.array(sorted(found), pa.string())})

        for batch in batches:
            for text in batch.column(1):
                plain, spaced = split.units(text.as_py() or "")
                firsts.update(plain)
                units.update(spaced)
                if len(units) + len(firsts) > UNITS:
                    yield words()
                    units.clear()
                    firsts.clear()
        yield words()

    return texts_of(docs, id_col, text_col).mapInArrow(of, "word string").distinct()


def frequencies(docs: DataFrame, spec: str, id_col: str, text_col: str) -> DataFrame:
    """(kind, word, block, places): kind 0 rows are a block's distinct pre-tokens, kind 1 its documents.

    The places of a document row hold the ids, byte lengths and validity, packed.
    """
    schema = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("block", pa.int64()), ("places", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(spec)
        first, done = TaskContext.get().partitionId() << 32, 0
        # units by number, those after a space and those without one, and their counts by document
        units: dict[str, int] = {}
        firsts: dict[str, int] = {}
        which, counts, owners, ids, sizes = [], [], [], [], []
        pairs = 0

        def block() -> Iterator[pa.RecordBatch]:
            number, n_units = first + done, len(units)
            codes: dict[str, int] = {}
            code, length = array("q"), array("i")
            for known, space in ((units, " "), (firsts, "")):
                for unit in known:
                    found = split.pre_tokens(unit, space)
                    length.append(len(found))
                    code.extend([codes.setdefault(w, len(codes)) for w in found])
                known.clear()
            names = sorted(codes)
            # in the order of the words, so that neighbouring rows are alike
            rank = np.empty(len(names), dtype=np.int64)
            rank[np.fromiter(map(codes.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
            codes.clear()
            code, length = rank[np.frombuffer(code, np.int64)], np.frombuffer(length, np.int32)
            start = np.cumsum(length) - length
            # entries of units to entries of their pre-tokens: word, document and count in one number
            unit, owner, count = split_counts(*map(np.concatenate, (which, owners, counts)))
            for column in (which, owners, counts):
                column.clear()
            unit[unit < 0] = n_units - 1 - unit[unit < 0]
            times = length[unit]
            ends = np.cumsum(times)
            spread = np.arange(ends[-1] if len(ends) else 0)
            spread += np.repeat(start[unit] - ends + times, times)
            keys = code[spread].astype(np.uint64)
            del spread, ends, unit
            keys <<= np.uint64(16)
            keys |= np.repeat(owner, times).astype(np.uint64)
            keys <<= np.uint64(COUNT_BITS)
            keys |= np.repeat(count, times).astype(np.uint64)
            del owner, count, times
            keys.sort()
            n = (keys & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
            keys >>= np.uint64(COUNT_BITS)
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            spot, n = keys[begin].astype(np.int64), np.add.reduceat(n, begin) if len(begin) else n
            del keys
            entries, taken = packed(spot & 0xFFFF, n)
            cuts = np.append(0, np.cumsum(taken))[np.searchsorted(spot, np.arange(len(names) + 1) << 16)]
            del spot, n, taken
            for low in range(0, len(names), 50_000):
                high = min(low + 50_000, len(names))
                raw = entries[cuts[low] : cuts[high]].tobytes()
                ends = (3 * (cuts[low : high + 1] - cuts[low])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(high - low, np.int32)),
                        pa.array(names[low:high], pa.string()),
                        pa.array(np.full(high - low, number)),
                        pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends), pa.py_buffer(raw)]),
                    ],
                    schema=schema,
                )
            there = np.array([i is not None for i in ids], "<u1")
            own = np.array([i or 0 for i in ids], "<i8")
            raw = own.tobytes() + np.array(sizes, "<i8").tobytes() + there.tobytes()
            yield pa.RecordBatch.from_pylist([{"kind": 1, "word": str(number), "block": number, "places": raw}], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                plain, spaced = split.units(text)
                found = Counter(spaced)
                for u in found:
                    if u not in units:
                        units[u] = len(units)
                for u in plain:
                    firsts.setdefault(u, len(firsts))
                # numbers of units without a space count down from -1 until the block ends
                which.append(np.fromiter(map(units.__getitem__, found), np.int32, len(found)))
                which.append(-1 - np.fromiter(map(firsts.__getitem__, plain), np.int32, len(plain)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
                counts.append(np.ones(len(plain), np.int32))
                owners.append(np.full(len(found) + len(plain), len(ids), np.int32))
                ids.append(i)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                pairs += len(found) + len(plain)
                if pairs >= PAIRS or len(ids) >= DOCUMENTS:
                    yield from block()
                    units, firsts, which, counts, owners, ids, sizes = {}, {}, [], [], [], [], []
                    done, pairs = done + 1, 0
        if ids:
            yield from block()

    return texts_of(docs, id_col, text_col).mapInArrow(of, "kind int, word string, block long, places binary")


def contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column as one array, and the length of each value."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, np.diff(ends)


def pieces(words: DataFrame, spec: str) -> DataFrame:
    """(word, n): how many tokens each word is, encoded once."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = Tokenizer.from_str(spec)
        known.no_truncation()
        known.no_padding()
        for part in parts:
            yield pd.Series([len(e) for e in known.encode_batch_fast(part.tolist(), add_special_tokens=False)])

    return words.withColumn("n", count(F.col("word")))


def token_counts(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens) per row of ``docs``, whole texts, by a ``tokenizers`` JSON file.

    Null and empty texts have 0 of both. Rows that repeat an id stay apart. Special
    strings in a text are one token each, as is the library's default; none is
    added, nothing is cut or padded.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    rows = frequencies(docs, spec, id_col, text_col)
    counted = pieces(vocabulary(docs, spec, id_col, text_col), spec).select(F.lit(0).alias("kind"), "word", "n")
    joined = rows.join(counted, ["kind", "word"], "left").select("kind", "block", "places", F.coalesce("n", F.lit(0)).alias("n"))

    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("places", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        none, held = np.zeros(0, np.int64), 0

        def passed() -> Iterator[pa.RecordBatch]:
            for number, total in sums.items():
                at = np.flatnonzero(total)
                raw = at.astype("<u2").tobytes() + total[at].astype("<i8").tobytes()
                yield pa.RecordBatch.from_pylist([{"block": number, "kind": 0, "places": raw}], schema=schema)

        for batch in batches:
            kind = batch.column(0).to_numpy()
            for row in np.flatnonzero(kind).tolist():
                yield pa.RecordBatch.from_pylist(
                    [{"block": batch.column(1)[row].as_py(), "kind": 1, "places": batch.column(2)[row].as_py()}], schema=schema
                )
            batch = batch.filter(pa.array(kind == 0))
            numbers, which = np.unique(batch.column(1).to_numpy(), return_inverse=True)
            raw, lengths = contents(batch.column(2))
            entries, lengths = raw.reshape(-1, 3).astype(np.int64), lengths // 3
            n = np.repeat(batch.column(3).to_numpy().astype(np.int64), lengths) * entries[:, 2]
            spot = np.repeat(which.astype(np.int64), lengths) << 16 | entries[:, 1] << 8 | entries[:, 0]
            order = np.argsort(spot, kind="stable")
            spot, first = np.unique(spot[order], return_index=True)
            n = np.add.reduceat(n[order], first) if len(first) else n
            cuts = np.searchsorted(spot, np.arange(len(numbers) + 1) << 16)
            for k, number in enumerate(numbers.tolist()):
                here, more = spot[cuts[k] : cuts[k + 1]] & 0xFFFF, n[cuts[k] : cuts[k + 1]]
                total = sums.get(number, none)
                if len(here) and here[-1] >= len(total):
                    held += here[-1] + 1 - len(total)
                    total = sums[number] = np.append(total, np.zeros(here[-1] + 1 - len(total), np.int64))
                total[here] += more
            if held > SUMS:
                yield from passed()
                sums.clear()
                held = 0
        yield from passed()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by block, the documents (kind 1) after the sums (kind 0)
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not kind:
                    size = len(raw) // 10
                    total[np.frombuffer(raw, "<u2", size)] += np.frombuffer(raw, "<i8", size, 2 * size)
                    continue
                size = len(raw) // 17
                there = np.frombuffer(raw, "<u1", size, 16 * size) == 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(np.frombuffer(raw, "<i8", size), mask=~there),
                        "n_bytes": pa.array(np.frombuffer(raw, "<i8", size, 8 * size)),
                        "n_tokens": pa.array(total[:size].copy()),
                    }
                )
                total[:] = 0

    return (
        joined.mapInArrow(partial, "block long, kind int, places binary")
        .repartition(shuffle_width(docs.sparkSession), "block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(summed, "id long, n_bytes long, n_tokens long")
    )
