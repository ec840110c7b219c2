"""Spelling variants against a plain version over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm import queries, variants as v

DOCS = "doc_id long, text string"


def plain_counts(rows):
    count = Counter()
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return count


def near_words(words):
    """Words by all words one edit away, by deleting and replacing letters."""
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    out = {w: set() for w in words}
    for (a, b), some in holes.items():
        for w in some:
            out[w] |= some - {w}
        if a + b in out:
            for w in some:
                out[w].add(a + b)
                out[a + b].add(w)
    return out


def plain(count, least_count=3, least_letters=5):
    n = {w: k for w, k in count.items() if k >= least_count and len(w) >= least_letters}
    near = near_words(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def found(frame):
    key = lambda r: r[0]
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key)


def words_like(rng, n, letters="abcdetéÿ", longest=8):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, longest))) for _ in range(n)]
    out = list(base)
    for w in base:
        i = rng.randrange(len(w))
        out += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], "".join(rng.sample(w, len(w)))]
    return out


@pytest.mark.parametrize("subtree", [50_000, 40, 3])
def test_pairs_equal_all_pairs(spark, subtree):
    rng = random.Random(subtree)
    words = {w for w in words_like(rng, 120) if w} | {"a" * 40, "a" * 41, "a" * 39 + "b", "x" * 32, "x" * 33, "x" * 31, "x" * 31 + "y"}
    words |= {"a" * 300, "a" * 301, "a" * 299 + "é", "ab" * 20 + "c", "c" + "ab" * 20}
    frame = spark.createDataFrame([(w, len(w) + 2) for w in sorted(words)], "word string, n long")
    got = sorted((r.word, r.near, r.near_n) for r in v.pairs(frame, subtree).collect())
    near = near_words(words)
    assert got == sorted((a, b, len(b) + 2) for a in words for b in near[a])
    assert len(got) == len(set(got)) and got


def test_anagrams_meet_at_one_leaf(spark):
    rng = random.Random(1)
    words = {"".join(rng.sample("aabbccdde", 9)) for _ in range(300)} | {"".join(rng.choice("vkjxqz") for _ in range(5)) for _ in range(300)}
    frame = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    near = near_words(words)
    for most in (50_000, 20):
        got = sorted((r.word, r.near) for r in v.pairs(frame, most).collect())
        assert got == sorted((a, b) for a in words for b in near[a])


def test_letters_are_deleted_by_checksum(spark):
    rng = random.Random(8)
    rows = [(i if i % 5 else None, " ".join(words_like(rng, 30, "abcDEé×÷")) + rng.choice(["", "x" * 90, "é" * 50, "日本 abc日def", "áb"])) for i in range(200)]
    rows += [(1, None), (2, ""), (3, "1234 !"), (None, None)]
    got = {r.word: r.n for r in v.word_counts(spark.createDataFrame(rows, DOCS)).collect()}
    expected = plain_counts(rows)
    assert got == dict(expected)
    assert sum(zlib.crc32(f"{i}:{w}".encode()) % 97 == 0 for i, t in rows if i and t for w in re.findall("[a-zé]+", t)) > 20


def test_whole_operator_equals_the_plain_version(spark):
    rng = random.Random(12)
    common = words_like(rng, 60, "abct", 7)
    rows = [(i, " ".join(common[min(len(common) - 1, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(120)))) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    expected = plain(plain_counts(rows))
    assert any(r[1] and r[2] != r[1] for r in expected)
    assert found(v.spelling_variants(docs)) == expected
    assert found(v.spelling_variants(docs.repartition(7), subtree=5)) == expected
    odd = docs.withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("branch", F.lit(2))
    assert found(v.spelling_variants(odd)) == expected


def test_ties_and_chains(spark):
    counts = {"abcde": 3, "abcdx": 6, "abcdy": 6, "abcdxy": 12, "zzzzzz": 5, "zzzzzy": 9}
    rows = [(0, " ".join([w] * n)) for w, n in counts.items()]
    rows = [(d, t) for d, t in rows]
    # ids whose checksums alter none of these words
    safe = next(i for i in range(10_000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in counts))
    got = {r[0]: r[1:] for r in found(v.spelling_variants(spark.createDataFrame([(safe, t) for _, t in rows], DOCS)))}
    assert got["abcde"] == ("abcdx", "abcdxy", 3, 2, 6)
    assert got["abcdx"] == ("abcdxy", "abcdxy", 6, 3, 12)
    assert got["zzzzzz"] == (None, "zzzzzz", 5, 1, None)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a bc")], DOCS)
    assert found(v.spelling_variants(docs)) == found(v.spelling_variants(docs.limit(0))) == []


def test_very_long_run(spark):
    rows = [(1, "a" * 200_000), (2, "a" * 200_000), (3, "a" * 200_001), (4, "a" * 200_001), (5, "a" * 200_001), (6, "a" * 200_000)]
    expected = plain_counts(rows)
    got = {r.word: r.n for r in v.word_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == dict(expected)
    known = {w: n for w, n in expected.items() if n >= 3}
    assert [(r[0], r[3]) for r in found(v.spelling_variants(spark.createDataFrame(rows, DOCS)))] == sorted(known.items())
    short = [(i, t[:2000]) for i, t in rows[:3]] + [(i, t[:2001]) for i, t in rows[2:]]
    assert found(v.spelling_variants(spark.createDataFrame(short, DOCS))) == plain(plain_counts(short))


def test_query_equals_the_plain_version(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_spelling_variants(spark, path)) == plain(plain_counts(rows))
