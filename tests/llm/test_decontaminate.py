import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import decontaminate as dc
from logloom.llm.common import table

DOCS = "doc_id long, text string, item_id long, start long, t string"
ITEMS = "item_id long, text string, doc_id int"


def least_edits(passage, text):
    """Edits of the passage against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(passage):
        old, row = row, row.copy()
        row[0] = i + 1
        for j in range(len(text)):
            row[j + 1] = min(old[j] + (text[j] != c), old[j + 1] + 1, row[j] + 1)
    return int(row.min())


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "benchmark").orderBy("item_id").collect()]


def test_edits_against_brute_force(items):
    random.seed(6)
    index = dc.Index(items)
    for _ in range(60):
        which = random.randrange(len(items))
        text = list(items[which][1])
        for _ in range(random.randrange(int(len(text) * 0.11) + 1)):
            at, kind = random.randrange(len(text)), random.random()
            if kind < 0.33:
                text[at] = random.choice("abcxyz ")
            elif kind < 0.66:
                text.insert(at, random.choice("abcxyz "))
            else:
                del text[at]
        doc = items[which - 1][1][:40] + " " + "".join(text) + " " + items[which - 2][1][:40]
        edits = least_edits(dc.fold(items[which][1])[0].tolist(), dc.fold(doc)[0].tolist())
        found = [f for f in index.search([doc]) if f[1] == which]
        if edits <= index.budget[which]:
            assert min(f[4] for f in found) == edits
            assert all(0 <= f[2] < f[3] <= len(doc) for f in found)
        else:
            assert not found


def test_spans_are_of_the_text(items):
    index = dc.Index(items)
    text = "Vorher ÄÖ!  " + items[3][1].upper().replace(" ", " -- ") + " Nachher"
    ((_, item, start, end, edits),) = index.search([text])
    assert (item, edits) == (3, 0) and dc.fold(text[start:end])[0].tolist() == dc.fold(items[3][1])[0].tolist()


def test_every_occurrence_in_a_long_text(items):
    index = dc.Index(items)
    filler = "lorem ipsum dolor sit amet " * 4000
    text = items[0][1] + filler + items[0][1] + filler + items[1][1] + items[0][1]
    found = index.search([filler, text, None, ""])
    assert [(r, i) for r, i, *_ in found] == [(1, 0)] * 3 + [(1, 1)]


def test_table_against_brute_force(spark, items):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    found = {(r.id, r.item_id) for r in dc.passages(docs, bench).collect()}
    fold = lambda t: dc.fold(t)[0].astype("<u4").tobytes().decode("utf-32-le")
    texts = {r.doc_id: fold(r.text) for r in docs.collect()}
    planted = {(d, i) for d, t in texts.items() for i, p in items if fold(p) in t}
    assert planted and planted <= found
    index = dict(zip(range(len(items)), items))
    for d, i in found - planted:
        passage = fold(dict(index.values())[i])
        assert least_edits(passage, texts[d]) <= len(passage) * dc.EDITS


def test_odd_rows(spark):
    passage = "A passage of a benchmark, long enough to count as evidence."
    items = spark.createDataFrame([(1, passage, 0), (2, passage, 0), (3, None, 0), (4, "", 0), (5, "tiny", 0), (None, "another passage that is long enough", 0)], ITEMS)
    rows = [(1, None), (2, ""), (3, "tiny"), (4, passage), (4, passage), (None, "x " * 50_000 + passage), (6, "İ" * 40 + passage.upper())]
    docs = spark.createDataFrame([(i, t, 9, 9, "t") for i, t in rows], DOCS)
    found = sorted((r.id or 0, r.item_id) for r in dc.passages(docs, items).collect())
    assert found == [(0, 1), (0, 2)] + [(4, 1)] * 2 + [(4, 2)] * 2 + [(6, 1), (6, 2)]
    hit = docs.select("doc_id", dc.contaminated(docs, items).alias("hit")).collect()
    assert [r.hit for r in hit] == [False, False, False, True, True, True, True]


def test_empty_tables(spark):
    items, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([], DOCS)
    one = spark.createDataFrame([(1, "some text that is long", None, None, None)], DOCS)
    assert dc.passages(one, items).collect() == [] == dc.passages(docs, items).collect()
    assert one.select(dc.contaminated(one, items).alias("hit")).first().hit is False


def test_blocks_of_the_benchmark_find_the_same(spark, items):
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    parts = list(dc.blocks(bench, dc.EDITS, 2000))
    assert len(parts) > 2 and sorted(i for p in parts for i in p.ids) == [i for i, _ in items]
    texts = [t for _, t in items]
    whole = {(r, i) for r, k, *_ in dc.Index(items).search(texts) for i in [items[k][0]]}
    assert whole == {(r, p.ids[k]) for p in parts for r, k, *_ in p.search(texts)}


def all_occurrences(passage, text, budget):
    """(start, end, edits) by the definition, from the least edits and first start of every end."""
    ends = []
    row = [(0, j) for j in range(len(text) + 1)]
    for i, c in enumerate(passage):
        old, row = row, [(i + 1, 0)]
        for j in range(len(text)):
            row.append(min((old[j][0] + (text[j] != c), old[j][1]), (old[j + 1][0] + 1, old[j + 1][1]), (row[j][0] + 1, row[j][1])))
    best = {e: (cost, start) for e, (cost, start) in enumerate(row) if cost <= budget and start < e}
    out = []
    for e, (cost, start) in best.items():
        explained = any(
            (best[f][0], f) < (cost, e) and best[f][0] + abs(e - f) <= cost + 1 for f in range(e - budget - 2, e + budget + 3) if f in best and f != e
        )
        if cost == 0 or not explained:
            out.append((start, e, cost))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_every_occurrence_of_short_repeated_and_altered_passages(letters):
    rng = random.Random(len(letters))
    for size in [*range(1, 41), 60, 120]:
        for _ in range(6):
            passage = "".join(rng.choice(letters) for _ in range(size))
            parts = []
            for _ in range(rng.randrange(1, 7)):
                copy = list(passage)
                for _ in range(rng.randrange(0, size // 12 + 2)):
                    at = rng.randrange(len(copy) + 1)
                    copy[at : at + rng.randrange(2)] = rng.choice(["", "x", rng.choice(letters)])
                parts.append("".join(copy))
                parts.append("".join(rng.choice(letters + "z") for _ in range(rng.choice([0, 0, 3, 50]))))
            text = "".join(parts) + passage[: size // 2]
            index = dc.Index([(0, passage)], least=1)
            want = all_occurrences(passage, text, int(index.budget[0]))
            assert [(s, e, c) for _, _, s, e, c in index.search([text])] == want, (passage, text)


def test_passages_in_a_row_are_all_found():
    for passage, times in (("abcdefghij", 3), ("abcdefghijklmnopqrst", 5), ("aaaa", 4)):
        index = dc.Index([(0, passage)], least=1)
        exact = [f for f in index.search([passage * times]) if f[4] == 0]
        assert len(exact) == (times if passage != "aaaa" else 13)


def test_many_passages_with_a_shared_opening_stay_within_bounds(monkeypatch):
    import tracemalloc

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    opening = " ".join(word() for _ in range(12))
    items = [(i, opening + " " + " ".join(word() for _ in range(25))) for i in range(5000)]
    index = dc.Index(items)
    text = " ".join(opening for _ in range(200)) + " " + items[17][1] + " " + opening + " " + items[4321][1]
    dc.letters()
    tracemalloc.start()
    found = index.search([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, c) for _, i, _, _, c in found] == [(17, 0), (4321, 0)]
    assert peak < 300 << 20
    # openings that are most of the passage: every hit stays in slices
    few = dc.Index([(i, opening * 2 + f"tail{i:04d}") for i in range(300)])
    monkeypatch.setattr(dc, "HITS", 5000)
    assert {i for _, i, *_ in few.search([opening * 2 + "tail0123"])} == {i for _, i, *_ in dc.Index(
        [(i, opening * 2 + f"tail{i:04d}") for i in range(300)]).search([opening * 2 + "tail0123"])}


def test_slices_of_hits_change_nothing(items, monkeypatch):
    texts = [t for _, t in items] + [items[0][1] * 3, items[1][1] + items[2][1]]
    whole = dc.Index(items).search(texts)
    monkeypatch.setattr(dc, "HITS", 50)
    monkeypatch.setattr(dc, "ALIGNED", 3)
    monkeypatch.setattr(dc, "WINDOWS", 100)
    monkeypatch.setattr(dc, "COMMON", 1)
    assert dc.Index(items).search(texts) == whole


def test_very_long_passage():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(3_000))
    altered = list(passage)
    for _ in range(100):
        altered[rng.randrange(len(altered))] = "x"
    ((_, _, start, end, edits),) = dc.Index([(0, passage)]).search(["zz" + "".join(altered) + "zz"])
    assert (start, end) == (2, 3_002) and 90 <= edits <= 100


def test_one_block_of_passages_per_pass(spark, items):
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("item_id", F.lit(1))
    hit = {r.doc_id for r in docs.select("doc_id", dc.contaminated(docs, bench).alias("hit")).filter("hit").collect()}
    for letters in (dc.BLOCK, 2000):
        kept = dc.without_passages(docs, bench, letters_each=letters)
        assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.collect()} == hit and kept.columns == docs.columns
    whole, parts = dc.passages(docs, bench), dc.passages(docs, bench, letters_each=2000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    with pytest.raises(ValueError):
        dc.contaminated(docs, spark.createDataFrame([(1, "x" * (dc.BLOCK + 1), 0), (2, "y", 0)], ITEMS))
