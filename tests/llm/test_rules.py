"""Quality rules: counts against a plain version, cutoffs against the exact bound."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.llm import queries, rules
from tests.compare import canonical, connect

DOCS = "doc_id long, text string, lang string"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_equal_the_plain_version():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a a a a", "a b c a b c", "a\x0bb\x0cc\x1cd e f", "é\r\né\r\n", "x\n\nx\n \n", "<a|b>"]
    texts += ["".join(rng.choice("ab #\n\té\r|") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts.append("w " * 200_000)
    for text in texts:
        assert rules.counts_of(text) == plain_counts(text), text


def binomial(k, n, rate):
    return sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


def test_tail_is_the_exact_binomial():
    for n in (1, 7, 60, 400):
        for rate in (0.004, 0.02, 0.3):
            for k in range(0, math.ceil(n * rate)):
                assert rules.tail(k, n, rate) == pytest.approx(binomial(k, n, rate), rel=1e-9)
            assert rules.tail(math.ceil(n * rate), n, rate) == 1.0
    assert rules.tail(0, 0, 0.1) == 1.0
    # the least sample without a rejection that certifies a rate
    n = math.ceil(math.log(0.01) / math.log(1 - 0.004))
    assert rules.tail(0, n, 0.004) <= 0.01 < rules.tail(0, n - 1, 0.004)
    assert 0 < rules.tail(39_000, 10_000_000, 0.004) < 1e-6


def labelled(spark, rows):
    """rows: (stratum, good, symbols per 100 words, times)"""
    out = []
    for stratum, good, symbols, times in rows:
        out += [(stratum, good, len(out) + i, 100, 500, symbols, 10, 0, 0) for i in range(times)]
    names = "stratum string, good boolean, copy long, " + ", ".join(f"{c} long" for c in rules.COUNTS)
    return spark.createDataFrame(out, names)


def test_cutoffs_are_the_certified_ones(spark):
    one = rules.Rule("symbols", "n_symbols", "n_words", (900, 500, 100))
    rows = labelled(
        spark,
        [
            ("many", True, 0, 2000), ("many", True, 30, 40), ("many", False, 95, 50), ("many", False, 60, 50), ("many", False, 20, 50),
            ("few", True, 0, 30), ("few", False, 95, 30),
            ("same", True, 0, 1000), ("same", True, 99, 8), ("same", False, 0, 1000), ("same", False, 99, 8),
        ],
    )
    found = {r.stratum: r.symbols for r in rules.certified(rows, "stratum", [one], risk=0.02, error=0.05).collect()}
    # 40 of 2,040 are too many at 2 %; the cutoff before rejects none of the good
    assert found == {"many": 500, "few": None, "same": None}
    assert rules.tail(0, 2040, 0.02) <= 0.05 / 3 < rules.tail(40, 2040, 0.02)


def test_copies_are_one_draw(spark):
    one = rules.Rule("symbols", "n_symbols", "n_words", (500,))
    rows = labelled(spark, [("x", True, 0, 400), ("x", False, 95, 5)])
    assert rules.certified(rows, "stratum", [one]).first().symbols == 500
    assert rules.certified(rows.withColumn("copy", F.lit(1)), "stratum", [one]).first().symbols is None


def test_more_strata_and_rules_need_more_labels(spark):
    many = [rules.Rule(f"r{i}", "n_symbols", "n_words", (500,)) for i in range(20)]
    rows = labelled(spark, [("x", True, 0, 160), ("x", False, 95, 5)])
    assert rules.certified(rows, "stratum", many[:1]).first().r0 == 500
    assert rules.certified(rows, "stratum", many).first().r0 is None


def test_false_rejection_stays_within_the_risk(spark):
    """Over drawn label sets the cutoff in force has a true rate beyond the risk in at most ``error`` of them."""
    rng, one, bad = random.Random(5), rules.Rule("symbols", "n_symbols", "n_words", (900, 700, 500, 300, 100)), 0
    sets = []
    for trial in range(60):
        # a good text has s symbols per 100 words, uniform up to 20, but 4 in 100 up to 100
        draw = [rng.randrange(101) if rng.random() < 0.04 else rng.randrange(20) for _ in range(500)]
        sets += [(f"t{trial}", True, s, 1) for s in draw] + [(f"t{trial}", False, 95, 20)]
    found = rules.certified(labelled(spark, sets), "stratum", [one], risk=0.02, error=60 * 0.05).collect()
    for row in found:
        if row.symbols is not None:
            true = 0.04 * (100 - row.symbols / 10) / 101
            bad += true > 0.02
    assert sum(r.symbols is not None for r in found) > 20 and bad <= 8


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, None, "en"), (2, "", None), (None, long, None), (4, long, "en"), (4, long, "en"), (5, "a b " * 40, "fr")], DOCS
    ).withColumn("copy", F.lit(9)).withColumn("stratum", F.lit("x")).withColumn("n_words", F.lit(-1))
    labels = spark.createDataFrame([(4, 0), (4, 1), (None, 1), (5, None), (5, 7), (99, 1)], "doc_id long, quality int")
    rows = rules.quality_rules(docs, labels).collect()
    assert sorted(((r.doc_id, r.stratum, r.n_words, r.base_failed, r.kept) for r in rows), key=repr) == sorted(
        [
            (1, "en", 0, True, False), (2, "und", 0, True, False), (None, "und", 60, False, True),
            (4, "en", 60, False, True), (4, "en", 60, False, True), (5, "fr", 80, True, False),
        ],
        key=repr,
    )
    assert rules.quality_rules(docs.limit(0), labels).count() == 0
    assert rules.quality_rules(docs, labels.limit(0)).filter("kept").count() == 3


def test_many_strata_are_joined_with_large_ones_split(spark, monkeypatch):
    one = rules.Rule("symbols", "n_symbols", "n_words", (500,))
    rows = labelled(spark, [("x", True, 0, 400), ("x", False, 95, 5), ("y", False, 95, 3)])
    cutoffs = rules.certified(rows, "stratum", [one])
    small = rules.judged(rows, cutoffs, "stratum", ["copy"], [one])
    monkeypatch.setattr(rules, "BROADCAST_BYTES", -1)
    large = rules.judged(rows, cutoffs, "stratum", ["copy"], [one])
    count = lambda f: sorted(map(tuple, f.groupBy("stratum", "rejected_by").count().collect()), key=repr)
    assert count(small) == count(large) == sorted([("x", [], 400), ("x", ["symbols"], 5), ("y", [], 3)], key=repr)


def test_query_equals_its_sql_and_rejects_junk(spark):
    path = "/root/testdata/sf0.1"
    frame = queries.op11_quality_rules(spark, path)
    rows = [tuple(r) for r in frame.collect()]
    cursor = connect(path).execute(queries.RULES_SQL)
    names = [d[0] for d in cursor.description]
    assert canonical(frame.columns, rows) == canonical(names, cursor.fetchall())
    by = frame.columns.index("rejected_by")
    assert sum(bool(r[by]) for r in rows) > 100
