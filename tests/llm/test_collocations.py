"""Collocations against a plain count, the summaries against their guarantee."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from logloom.llm import collocations as c

ROWS = "lang string, text string"


def plain(rows, least, longest, top):
    """The contract by dictionaries, one language after the other."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                count.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in count.items():
        phrases = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        inside = set()
        for p, n in phrases.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p) and n >= f[p[i:j]]:
                        inside.add(p[i:j])
        ranked = []
        for p, a in phrases.items():
            if p in inside:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(seed, docs, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "é", "İ", "the", "The", "\x00", "\x1c"]
    fixed = ["new york city hall", "in spite of", "a b c d e f g"]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(fixed) if rng.random() < 0.2 else vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(0.08)))])
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b", "! "]))
        out.append((rng.choice(["en", "fr", None]), "".join(parts)))
    return out + [("en", None), ("en", ""), (None, " .. ")]


def found(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, top, chunk, capacity", [(5, 2000, 4 << 20, 1 << 21), (12, 20, 500, 40), (3, 7, 40, 3)])
def test_equals_the_plain_version(spark, monkeypatch, least, top, chunk, capacity):
    monkeypatch.setattr(c, "HELD", capacity)
    rows = texts(least, 300, 60)
    docs = spark.createDataFrame(rows, ROWS).repartition(5)
    expected = plain(rows, least, 5, top)
    assert expected
    assert found(c.collocations(docs, least, 5, top, chunk, capacity)) == expected


def test_ties_go_to_phrases_in_byte_order(spark):
    rows = [("en", f"{a} {b}.") for a, b in (("é", "x"), ("z", "y"), ("Z", "y"), ("\U00010000", "q"), ("￿", "q")) for _ in range(4)]
    got = found(c.collocations(spark.createDataFrame(rows, ROWS), 4))
    assert got == plain(rows, 4, 5, 2000) and len(got) == 4


def test_repeated_words_overlap(spark):
    rows = [("en", "la " * 50)]
    assert found(c.collocations(spark.createDataFrame(rows, ROWS), 10)) == plain(rows, 10, 5, 2000)


def test_large_counts_stay_exact(spark):
    frequent = spark.createDataFrame(
        [("en", "a b", 2, 3_000_000_000), ("en", "a", 1, 4_000_000_000), ("en", "b", 1, 5_000_000_000)], "lang string, phrase string, size int, n long"
    )
    totals = spark.createDataFrame([("en", 9_000_000_000_000_001)], "lang string, n long")
    row = c.scored(frequent, totals).first()
    assert row.score == 1000 * 3_000_000_000 * 9_000_000_000_000_001 // (4_000_000_000 * 5_000_000_000)


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(4)
    for trial in range(30):
        least = int(rng.integers(2, 40))
        keys = np.concatenate([rng.integers(0, 5000, 20_000), np.repeat(rng.integers(5000, 5100, 20), least)]).astype(np.uint64)
        rng.shuffle(keys)
        capacity = len(keys) // least + 1
        own, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part in np.array_split(keys, rng.integers(1, 50)):
            more, times = np.unique(part, return_counts=True)
            own, counts, gone = c.merged(np.concatenate([own, more]), np.concatenate([counts, times]), capacity)
            lost += gone
            assert len(own) <= capacity
        assert lost < least
        real = dict(zip(*np.unique(keys, return_counts=True)))
        left = dict(zip(own.tolist(), counts.tolist()))
        for key, n in real.items():
            assert 0 <= n - left.get(int(key), 0) <= lost
            assert n < least or int(key) in left


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "LEAST_BITS", 20)
    rows = texts(9, 150, 40)
    docs = spark.createDataFrame(rows, ROWS)
    expected = found(c.collocations(docs, 5))
    monkeypatch.setattr(c.Bits, "holds", lambda self, h: np.ones(len(h), dtype=bool))
    assert found(c.collocations(docs, 5)) == expected == plain(rows, 5, 5, 2000)


def test_counts_passed_on_do_not_grow_with_the_parts_of_the_input(spark):
    every = SimpleNamespace(value=c.Bits(8, np.full(32, 255, np.uint8)))
    rows = spark.createDataFrame([("en", "a b c")] * 400, ROWS).repartition(40)
    sent = c.counts_by_task(rows, every, every, every, [2, 3]).collect()
    assert len(sent) <= 3 * spark.sparkContext.defaultParallelism
    totals = Counter()
    for row in sent:
        totals[row.phrase] += row.n
    assert totals == {"a b": 400, "b c": 400, "a b c": 400}


def test_bits_hold_what_was_put_in(spark):
    h = spark.range(50_000).selectExpr("xxhash64(id) AS h")
    bits = c.Bits.of(h)
    inside = np.array([r.h for r in h.collect()]).view(np.uint64)
    assert bits.holds(inside).all()
    outside = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert bits.holds(outside).mean() < 0.02
    assert not c.Bits.of(h.limit(0)).holds(outside).any()


def test_long_texts_are_cut_between_pieces():
    raw = b"a b, c d. e f! " * 40 + b"x" * 300 + b" y"
    for size in (1, 7, 50, 10_000):
        parts = list(c.cut(raw, size))
        assert b"".join(parts) == raw
        whole = [p for part in parts for p in b" ".join(c.tokens(part)).split(b"\n") if p.strip()]
        assert [p.split() for p in whole] == [p.split() for p in b" ".join(c.tokens(raw)).split(b"\n") if p.strip()]


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(texts(2, 60, 20), ROWS)
    assert c.collocations(docs.limit(0)).count() == 0
    assert c.collocations(docs).count() == 0
    odd = docs.withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).withColumn("part", F.lit(None).cast("int"))
    assert found(c.collocations(odd, 4)) == found(c.collocations(docs, 4))
