import numpy as np
import pytest
import pytest
from pyspark.sql import functions as F

from logloom.llm import quality
from logloom.llm.common import held_out, table

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, quality string, half int, place long"
LABELS = "doc_id long, quality int, text string"


def test_held_out_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs.filter(~held_out()), labels.filter(~held_out()))
    rows = (
        docs.filter(held_out()).join(labels, "doc_id").select("quality", quality.score(F.col("text"), model).alias("s")).collect()
    )
    y, s = np.array([r.quality for r in rows]), np.array([r.s for r in rows])
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    good = y.sum()
    area = (rank[y == 1].sum() - good * (good - 1) / 2) / (good * (len(y) - good))
    assert area > 0.98
    assert ((s >= 0.3) == y).mean() > 0.95
    # calibrated: what scores say on average is what labels say
    assert abs(s.mean() - y.mean()) < 0.03


def test_difference_is_by_whole_text():
    good, bad = b"the and of to in is " * 50, b"zq xj vk wq qz jx " * 50
    a, b, none, empty = quality.difference(iter(["the and of to in " * 300, "zq xj vk wq " * 300, None, ""]), good, bad)
    assert a > 0 > b and none == empty == 0
    mixed = quality.difference(iter(["the and of to in " * 300 + "zq xj vk wq " * 3000]), good, bad)[0]
    assert mixed < a


def test_logistic_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, shift = quality.logistic(x, y, np.ones(4000))
    assert abs(slope - 2) < 0.25 and abs(shift + 1) < 0.2
    assert quality.logistic(np.zeros(0), np.zeros(0), np.zeros(0)) == (0.0, 0.0)
    # one class only: no fit runs away
    assert np.isfinite(quality.logistic(x, np.ones(4000), np.ones(4000))).all()


def test_odd_rows(spark):
    texts = [(i, f"fine words number {i} are here to stay " * 30, "q", 0, 1) for i in range(60)]
    texts += [(i, f"JUNK {i}!! " * 80, "q", 0, 1) for i in range(60, 120)]
    odd = [(200, None, None, None, None), (201, "", None, None, None), (None, "x", None, None, None), (5, "fine words", None, None, None)]
    docs = spark.createDataFrame(texts + odd + [(300, "long " * 100_000, None, None, None)], DOCS)
    labels = [(i, int(i < 60), "t") for i in range(120)] + [(5, 1, "t"), (None, 1, "t"), (999, 0, "t"), (7, None, "t"), (8, 3, "t"), (200, 0, "t")]
    model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
    rows = docs.select("doc_id", "text", quality.score(F.col("text"), model).alias("s")).collect()
    assert len(rows) == docs.count() and all(0 <= r.s <= 1 for r in rows)
    by = {r.doc_id: r.s for r in rows}
    assert by[200] == by[201]
    assert np.mean([by[i] for i in range(60)]) > np.mean([by[i] for i in range(60, 120)])


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    model = quality.fit(docs, labels)
    assert docs.select(quality.score(F.col("text"), model)).collect() == []
    one = spark.createDataFrame([(1, "text", None, None, None)], DOCS)
    assert one.select(quality.score(F.col("text"), model).alias("s")).first().s == pytest.approx(0.5)


def test_query_against_a_plain_version(spark):
    """Scores of the registered query, text by text with compressors of their own."""
    import zlib

    import zstandard

    from logloom.llm.queries import op4_quality

    path = "/root/testdata/sf0.01"
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    model = quality.fit(docs.filter(~held_out()), labels.filter(~held_out()))

    def size(raw, content):
        shared = zstandard.ZstdCompressionDict(content)
        side = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(side.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))

    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    found = op4_quality(spark, path).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found[::7]:
        raw = texts[r.doc_id]
        x = (size(raw, model.bad) - size(raw, model.good)) / max(1, len(raw))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * x + model.shift))), abs=1e-9)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in found)
