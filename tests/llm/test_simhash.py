import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import simhash
from logloom.llm.common import roots

SCHEMA = "doc_id long, text string, fp string, k long, id long, component_id string"


def slow_mark(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in "\t\n\x0b\x0c\r ":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBÉz \t\n\x0b\x1c é", max_size=60), st.integers(1, 5))
def test_fingerprint_of_one_text(text, width):
    assert simhash.simhash(text, width) == slow_mark(text, width)


def test_slices_of_a_long_text_add_up(monkeypatch):
    text = " ".join(str(i % 997) for i in range(5000))
    whole = simhash.simhash(text, 4)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.simhash(text, 4) == whole == slow_mark(text, 4)


def brute_groups(marks, bits):
    distinct = sorted(set(marks))
    pairs = [(i, j) for i in range(len(distinct)) for j in range(i) if (distinct[i] ^ distinct[j]).bit_count() <= bits]
    a, b = (np.array([p[k] for p in pairs], dtype=int) for k in range(2))
    label = roots(len(distinct), a, b)
    return {m: label[i] for i, m in enumerate(distinct)}


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = set()
    for c in centres.tolist():
        for _ in range(30):
            m = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                m ^= 1 << b
            marks.add(m - (1 << 64) if m >> 63 else m)
    frame = spark.createDataFrame([(m,) for m in marks], "fp long")
    expected = brute_groups([m % (1 << 64) for m in marks], 4)
    # whole buckets in one tile, buckets cut into many, and more blocks than the fewest
    for tile, bucket in ((512, 256), (8, 256), (16, 4)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        links = simhash.link(frame, 4).collect()
        index = {m: i for i, m in enumerate(sorted(m % (1 << 64) for m in marks))}
        a = np.array([index[r.a % (1 << 64)] for r in links])
        b = np.array([index[r.b % (1 << 64)] for r in links])
        label = roots(len(index), a, b)
        assert {m: label[i] for m, i in index.items()} == expected


def test_pivots_discard_no_pair_in_reach():
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    marks[30:] = marks[:30] ^ np.uint64(0b1011)
    ends = np.full(60, 60)
    zero = np.zeros(60, dtype=int)
    found = simhash.pairs_within(marks, ends, zero, zero > 0, 4, simhash.splitmix(24, 1))
    got = {(int(i), int(j)) for a, b in found for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if int(marks[i] ^ marks[j]).bit_count() <= 4}


def test_odd_rows(spark):
    long = "word " * 60_000 + "end"
    rows = [
        (5, None), (3, ""), (9, " \n\t"), (4, "The quick brown fox jumps"), (2, "the QUICK brown fox  jumps"),
        (7, long), (8, long), (8, long), (None, "the quick brown fox jumps"), (1, "x"),
    ]
    frame = spark.createDataFrame([(i, t, "a", 1, 2, "c") for i, t in rows], SCHEMA)
    got = {(r.id, r.fp, r.component_id) for r in simhash.near_groups(frame).collect()}
    by_id = {i: c for i, _, c in got}
    assert simhash.near_groups(frame).count() == len(rows)
    assert by_id == {5: 3, 3: 3, 9: 3, 4: 2, 2: 2, 7: 7, 8: 7, None: 2, 1: 1}
    assert all(f == 0 for i, f, _ in got if i in (3, 5, 9))


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
