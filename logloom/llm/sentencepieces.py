"""SentencePiece encoding and decoding by batched Viterbi.

The model file is read for its pieces and scores; encoding does not call the
library. Text is cut where no piece can reach across, which gives words. Words
of equal length advance together: all their substrings are hashed and probed in
the sorted hashes of the pieces, and at each letter a vectorised maximum picks
and stores the piece that ends there.

For a unigram model the maximum is of summed scores. A BPE model's scores are
merge ranks, whose best sum is not what merging gives. There the maximum is over
the pieces that may follow the one their start ends in: the encoding of a prefix
ends in exactly one piece, the one whose pair with its predecessor merging would
leave apart. That is decided by undoing merges on both sides of the boundary,
again for all words at once, and gives the ids that merging gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
# Words whose ids a worker keeps, letters of words of one length that advance together
KEPT = 300_000
TOGETHER = 1 << 17
PAIR_BITS = 22
# Letters of text whose words are encoded together
CHUNK = 1 << 21
# Slots for pairs of pieces of which is known whether merging leaves them apart
PAIR_SLOTS = 1 << 20

# What stands behind a word, and the place of a string that begins no piece
PAST, ABSENT = np.uint64(1 << 33), -2

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model: int
    prefix: bool
    fallback: bool


def load(raw: bytes) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with the identity normaliser."""
    pieces, scores, kinds = [], [], []
    model, fallback, rule, prefix, squeeze, escape = UNIGRAM, False, b"", True, True, True
    for number, value in fields(raw):
        if number == 1:
            told = dict(fields(value))
            pieces.append(told[1].decode())
            scores.append(np.frombuffer(told.get(2, b"\0\0\0\0"), "<f4")[0])
            kinds.append(told.get(3, NORMAL))
        elif number == 2:
            told = dict(fields(value))
            model, fallback = told.get(3, UNIGRAM), bool(told.get(35, 0))
        elif number == 3:
            told = dict(fields(value))
            rule, prefix, squeeze, escape = told.get(2, b""), bool(told.get(3, 1)), bool(told.get(4, 1)), bool(told.get(5, 1))
    if rule or squeeze or not escape or model not in (UNIGRAM, BPE) or USER in kinds:
        raise ValueError("only unigram and BPE models with the identity normaliser are supported")
    return Vocabulary(pieces, np.array(scores, dtype=np.float64), np.array(kinds), model, prefix, fallback)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        usable = [i for i in range(len(v.pieces)) if v.kinds[i] == NORMAL and v.pieces[i]]
        self.unknown = int(np.flatnonzero(v.kinds == UNKNOWN)[0])
        self.bytes = {int(v.pieces[i][1:-1], 16): i for i in np.flatnonzero(v.kinds == BYTE)}
        self.longest = max((len(v.pieces[i]) for i in usable), default=1)
        self.least = float(v.scores[usable].min()) - 10 if usable else -10.0
        # every prefix of a piece by hash, with the piece it is, or -1
        prefixes = {v.pieces[i][:n]: -1 for i in usable for n in range(1, len(v.pieces[i]) + 1)}
        prefixes.update((v.pieces[i], i) for i in usable)
        hashes = np.array([self.hash_of(x) for x in prefixes], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.ids = hashes[order], np.array(list(prefixes.values()), dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two prefixes of pieces share a hash")
        # where the hashes that begin with some bits are among all, at least four times as many beginnings as hashes
        self.shift = np.uint64(64 - max(8, (4 * len(self.keys)).bit_length()))
        heads = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.heads = np.concatenate([[0], np.cumsum(heads)]).astype(np.int32)
        self.crowd = int(heads.max())
        # pairs of letters that stand together in a piece; a false hit only makes a longer word
        self.inside = np.zeros(1 << PAIR_BITS, dtype=bool)
        joint = {p[k : k + 2] for i in usable for p in (v.pieces[i],) for k in range(len(p) - 1)}
        self.inside[self.pair_place(np.array([ord(x[0]) for x in joint]), np.array([ord(x[1]) for x in joint]))] = True
        # what a piece reads as; bytes that are letters do so by themselves, others in runs
        ends = {CONTROL: "", UNKNOWN: " \u2047 "}
        self.texts = [ends.get(k, p.replace(SPACE, " ")) for p, k in zip(v.pieces, v.kinds.tolist())]
        self.high = np.zeros(len(v.pieces), dtype=bool)
        for byte, i in self.bytes.items():
            self.texts[i], self.high[i] = chr(byte), byte > 127
        self.size = np.array([len(p) for p in v.pieces], dtype=np.int64)
        self.forget()
        if v.model == BPE:
            self.undo_merges(usable)

    def forget(self, but: set[str] = frozenset()) -> None:
        """Known words, as places in one run of ids: of those known only those of ``but`` are kept."""
        words = [w for w in but if w in self.known] if but else []
        if words:
            flat, size = self.ids_of(words)
            self.flat, self.first = flat, np.concatenate([[0], np.cumsum(size)])
        else:
            self.flat, self.first = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.known: dict[str, int] = dict(zip(words, range(len(words))))

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words in one run, and how many each has."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first, count = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.cumsum(count)
        return self.flat[np.arange(ends[-1] if len(at) else 0) + np.repeat(first - ends + count, count)], count

    @staticmethod
    def pair_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * BASE
        return (key >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    @staticmethod
    def hash_of(text: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in text:
                h = (h + np.uint64(ord(c) + 1)) * BASE
        return h

    def probed(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for other prefixes of pieces, ``ABSENT`` for what is none."""
        head = (h >> self.shift).astype(np.int64)
        at, end = self.heads[head], self.heads[head + 1]
        out = np.full(len(h), ABSENT, dtype=np.int64)
        left = np.flatnonzero(at < end)
        for n in range(self.crowd):
            here = at[left] + n
            on = self.keys[here] == h[left]
            out[left[on]] = self.ids[here[on]]
            left = left[~on & (here + 1 < end[left])]
            if not len(left):
                break
        return out

    def undo_merges(self, usable: list[int]) -> None:
        """For every piece its rank, the pair it is merged from and whether merging can make it.

        Ranks order the merges, best score first; single letters come before all.
        Pieces are made in that order, so a piece's own encoding ends in the pair that
        the pieces before it leave of it.
        """
        v = self.v
        order = sorted(usable, key=lambda i: (len(v.pieces[i]) > 1, -v.scores[i], i))
        n = len(v.pieces) + 1
        self.none = n - 1
        self.rank = np.full(n, np.iinfo(np.int64).max)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.arange(n), np.arange(n)
        by_text = {v.pieces[i]: i for i in usable}
        rank = {v.pieces[i]: r for r, i in enumerate(order)}
        self.made = np.zeros(n, dtype=bool)
        pair = []
        for i in order:
            parts = list(v.pieces[i])
            while len(parts) > 2:
                merges = [(rank.get(a + b, n), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
                best, k = min(merges)
                if best >= rank[v.pieces[i]]:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                self.made[i] = True
            elif len(parts) == 2 and all(p in by_text for p in parts):
                a, b = (by_text[p] for p in parts)
                self.made[i], self.left[i], self.right[i] = True, a, b
                pair.append((a * n + b, i))
        pair.sort()
        self.slot_keys = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.slot_apart = np.zeros(PAIR_SLOTS, dtype=bool)
        self.pair_keys = np.array([k for k, _ in pair], dtype=np.int64)
        self.pair_ids = np.array([i for _, i in pair], dtype=np.int64)

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that merging ``a`` and ``b`` makes; beyond all ranks if none."""
        key = a * (self.none + 1) + b
        if not len(self.pair_keys):
            return np.full(len(key), np.iinfo(np.int64).max)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.rank[self.pair_ids[at]], np.iinfo(np.int64).max)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`stays_apart` of each pair, remembered in slots by a hash of the pair."""
        key = a * (self.none + 1) + b
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64) & (PAIR_SLOTS - 1)
        new = np.flatnonzero(self.slot_keys[slot] != key)
        out = self.slot_apart[slot]
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.stays_apart(a[new[first]], b[new[first]])
            out[new] = found[back]
            self.slot_keys[slot[new[first]]] = key[new[first]]
            # of several pairs for one slot the last written is kept, so results are read back by key
            kept = self.slot_keys[slot[new[first]]] == key[new[first]]
            self.slot_apart[slot[new[first[kept]]]] = found[kept]
        return out

    def stays_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between pieces ``a`` and ``b``.

        The later made of the two is undone, on its side of the boundary; the pair
        then at the boundary must not have been merged before that later merge. On
        the left side equal ranks merge first.
        """
        out = np.ones(len(a), dtype=bool)
        rows, a, b = np.arange(len(a)), a.copy(), b.copy()
        # merges at the boundary that come before this step would have happened: (rank, side)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(rows):
            at = self.merged_rank(a, b)
            bad = at < limit
            out[rows[bad]] = False
            ra = np.where(self.left[a] == a, -1, self.rank[a])
            rb = np.where(self.left[b] == b, -1, self.rank[b])
            go = ~bad & ((ra >= 0) | (rb >= 0))
            rows, a, b, ra, rb = rows[go], a[go], b[go], ra[go], rb[go]
            # of equal ranks the left merge was made first, so the right one is undone first
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return out

    def words(self, text: str) -> list[str]:
        """The text in words no piece reaches across, spaces as marks, with the dummy prefix."""
        if not text:
            return []
        marked = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
        points = code_points(marked)
        cuts = np.flatnonzero(~self.inside[self.pair_place(points[:-1], points[1:])]) + 1
        edges = [0, *cuts.tolist(), len(marked)]
        return [marked[a:b] for a, b in zip(edges, edges[1:])]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of one length, in one run, and how many each has."""
        size = len(words[0])
        points = code_points("".join(words)).reshape(len(words), size).astype(np.uint64)
        # piece of every (word, start, length), by hashes that grow letter by letter; no piece goes on past a word
        wide = size + 1
        letters = np.full((len(words), wide), PAST, dtype=np.uint64)
        letters[:, :size] = points + np.uint64(1)
        letters = letters.ravel()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cell = (np.arange(len(words))[:, None] * wide + np.arange(size)).ravel()
        h = np.zeros(len(cell), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(size, self.longest) + 1):
                h = (h + letters[cell + (n - 1)]) * BASE
                piece = self.probed(h)
                on = np.flatnonzero(piece > ABSENT)
                cell, h, piece = cell[on], h[on], piece[on]
                if not len(cell):
                    break
                hit = piece >= 0
                found.append((cell[hit], piece[hit]))
        cell, piece = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(2))
        # a letter that is no piece stands for itself
        single = np.zeros((len(words), wide), dtype=bool)
        single[:, size] = True
        single.ravel()[cell[self.size[piece] == 1]] = True
        lone = np.flatnonzero(~single)
        cell, piece = np.concatenate([cell, lone]), np.concatenate([piece, np.full(len(lone), -1)])
        row, start = np.divmod(cell, wide)
        end = start + np.where(piece < 0, 1, self.size[piece])
        order = np.argsort(end.astype(np.uint16) if size < 1 << 16 else end, kind="stable")
        row, start, piece = row[order], start[order], piece[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=size + 1)[1:])])
        if self.v.model == BPE:
            last, back = self.by_merges(len(words), size, row, start, piece, bounds)
        else:
            last, back = self.by_scores(len(words), size, row, start, piece, bounds)
        return self.walk(points, last, back)

    def by_merges(self, n: int, size: int, row, start, piece, bounds):
        """Per word and end the last piece of the prefix's encoding, and where it starts."""
        last = np.full((n, size + 1), self.none, dtype=np.int64)
        back = np.zeros((n, size + 1), dtype=np.int64)
        code = np.where(piece < 0, self.none, piece)
        for end in range(1, size + 1):
            span = slice(bounds[end - 1], bounds[end])
            r, s, p = row[span], start[span], code[span]
            fits = self.made[p] | (p == self.none)
            r, s, p = r[fits], s[fits], p[fits]
            before = last[r, s]
            check = (s > 0) & (before != self.none) & (p != self.none)
            fits = np.ones(len(r), dtype=bool)
            fits[check] = self.apart(before[check], p[check])
            # a prefix that ends in no piece here is one no encoding reaches
            fits &= (s == 0) | (back[r, s] >= 0)
            value = np.where(fits, self.size[np.minimum(p, self.none - 1)] * (p != self.none) + 1, 0)
            top = np.zeros(n, dtype=np.int64)
            np.maximum.at(top, r, value)
            best = fits & (value == top[r])
            back[:, end] = -1
            last[r[best], end], back[r[best], end] = p[best], s[best]
        return np.where(last == self.none, -1, last), back

    def by_scores(self, n: int, size: int, row, start, piece, bounds):
        """Per word and end the last piece of the best sum of scores, and where it starts."""
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0
        last = np.full((n, size + 1), -1, dtype=np.int64)
        back = np.zeros((n, size + 1), dtype=np.int64)
        for end in range(1, size + 1):
            span = slice(bounds[end - 1], bounds[end])
            r, s, p = row[span], start[span], piece[span]
            value = total[r, s] + np.where(p < 0, self.least, self.v.scores[p])
            np.maximum.at(total[:, end], r, value)
            # of equal sums the longest piece
            order = np.flatnonzero(value == total[r, end])
            order = order[np.argsort(-s[order], kind="stable")]
            last[r[order], end], back[r[order], end] = p[order], s[order]
        return last, back

    def walk(self, points: np.ndarray, last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back along the stored pieces, all words a step at a time; then letters without a piece as bytes."""
        n, size = points.shape
        at, rows, steps = np.full(n, size), np.arange(n), []
        while len(rows):
            piece, start = last[rows, at], back[rows, at]
            steps.append((rows, start, piece))
            rows, at = rows[start > 0], start[start > 0]
        row, start, piece = (np.concatenate([s[k] for s in steps]) for k in range(3))
        order = np.lexsort((start, row))
        row, start, piece = row[order], start[order], piece[order]
        lone = np.flatnonzero(piece < 0)
        if len(lone):
            spelled = [self.spelled(int(points[row[i], start[i]])) for i in lone]
            if not self.v.fallback:
                # neighbouring unknown letters are one unknown piece
                again = np.zeros(len(piece), dtype=bool)
                again[1:] = (piece[1:] < 0) & (piece[:-1] < 0) & (row[1:] == row[:-1])
                spelled = [[] if again[i] else s for i, s in zip(lone, spelled)]
            times = np.ones(len(piece), dtype=np.int64)
            times[lone] = [len(s) for s in spelled]
            row, piece = np.repeat(row, times), np.repeat(piece, times)
            piece[piece < 0] = [i for s in spelled for i in s]
        return piece.astype(np.int32), np.bincount(row, minlength=n)

    def spelled(self, point: int) -> list[int]:
        if not self.v.fallback:
            return [self.unknown]
        return [self.bytes[b] for b in chr(point).encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty one."""
        cut = [self.words(t or "") for t in texts]
        if len(self.known) > KEPT:
            # the words of this text are likely those of the next
            self.forget(set().union(*cut))
        new: dict[int, list[str]] = {}
        for word in {w for words in cut for w in words if w not in self.known}:
            new.setdefault(len(word), []).append(word)
        flat, sizes = [self.flat], []
        for size, words in new.items():
            step = max(1, TOGETHER // size)
            for k in range(0, len(words), step):
                ids, counts = self.encode_words(words[k : k + step])
                self.known.update(zip(words[k : k + step], range(len(self.known), len(self.known) + len(counts))))
                flat.append(ids)
                sizes.append(counts)
        if sizes:
            self.flat = np.concatenate(flat)
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
        return [self.ids_of(words)[0] for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids; control pieces vanish, bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids)
        listed = ids.tolist()
        if not self.high[ids].any():
            text = "".join(map(self.texts.__getitem__, listed))
        else:
            out, run = [], bytearray()
            for i in listed:
                if self.high[i]:
                    run.append(int(self.v.pieces[i][1:-1], 16))
                    continue
                out += [replaced(run), self.texts[i]]
                run.clear()
            text = "".join([*out, replaced(run)])
        # the dummy prefix is a space mark at the head of the first piece that reads as anything
        first = next((self.v.pieces[i] for i in listed if self.v.kinds[i] != CONTROL), "")
        return text[1:] if self.v.prefix and first.startswith(SPACE) else text


def replaced(raw: bytearray) -> str:
    """UTF-8 to text, every byte that is none as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def chunks(texts: list, size: int = CHUNK) -> Iterator[list]:
    part, total = [], 0
    for text in texts:
        part.append(text)
        total += len(text) if text is not None else 0
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> Encoder:
    """The encoder of a model file's content, kept by a worker from task to task with the words it knows."""
    return Encoder(load(model))


def encoded(text: Column, model: bytes) -> Column:
    """The ids of a whole text, without begin or end; an empty array for null and empty texts.

    ``model`` is the content of a SentencePiece file; strings of control pieces in
    a text are ordinary text.
    """

    @F.pandas_udf("array<int>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(model)
        for part in parts:
            yield pd.Series([ids for some in chunks(part.tolist()) for ids in encoder.encode(some)], dtype=object)

    return of(text)


def round_trip(text: Column, model: bytes) -> Column:
    """struct(ids, exact): the ids of a whole text, and whether they decode to it, in one pass.

    A null or empty text has no ids and is exact.
    """

    @F.pandas_udf("ids array<int>, exact boolean")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(model)
        for part in parts:
            texts = part.tolist()
            ids = [i for some in chunks(texts) for i in encoder.encode(some)]
            exact = [encoder.decode(i) == (t or "") for i, t in zip(ids, texts)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "exact": pd.Series(exact, dtype=bool)})

    return of(text)


def decoded(ids: Column, model: bytes) -> Column:
    """The text of an array of ids; null for null. It is the text encoded, but that a space mark reads as a space."""

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(model)
        for part in parts:
            yield pd.Series([None if p is None else encoder.decode(p) for p in part], dtype=object)

    return of(ids)
