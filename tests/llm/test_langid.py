import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import langid
from logloom.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, h string, total long"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(table(spark, SF, "documents").filter(~held_out()))


def predict(spark, frame, model):
    rows = frame.select("doc_id", langid.detect(F.col("text"), model, spark).alias("p")).collect()
    return [(r.doc_id, r.p.lang, r.p.score) for r in rows]


def test_held_out_accuracy(spark, model):
    docs = table(spark, SF, "documents").filter(held_out() & F.col("lang").isNotNull())
    true = {r.doc_id: r.lang for r in docs.collect()}
    found = predict(spark, docs, model)
    assert np.mean([true[i] == lang for i, lang, _ in found]) > 0.98
    assert all(0 <= s <= 1 for *_, s in found)


def slow_word(model, word):
    if word in model.words:
        return model.logs[model.words[word]]
    marked = langid.EDGE + word + langid.EDGE
    for n in langid.ORDERS:
        known = [model.grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in model.grams]
        if known:
            return model.logs[known].mean(axis=0)
    return np.zeros(len(model.languages))


def test_words_then_shorter_and_shorter_grams(model):
    random.seed(2)
    words = ["the", "und", "zzzzqqq", "theund", "ñandú", "猫", "x"] + ["".join(random.choices("aeothnrdü", k=random.randint(1, 9))) for _ in range(300)]
    got = model.scores(words)
    for word, row in zip(words, got):
        assert np.allclose(row, slow_word(model, word))


def test_memory_of_words_changes_nothing(model, monkeypatch):
    texts = ["the of and", "der die und", "la de que", "zzz qqq", "the der la"] * 3
    whole = langid.Scorer(model)(texts)
    monkeypatch.setattr(langid, "KEPT", 2)
    monkeypatch.setattr(langid, "CHUNK", 5)
    scorer = langid.Scorer(model)
    assert [r for some in langid.chunks(texts) for r in scorer(some)] == whole


def test_odd_rows(spark, model):
    long = "der die und das " * 20_000
    rows = [(1, None), (2, ""), (3, "123 -- ½ _"), (4, "the of and to in"), (4, "the of and to in"), (None, long), (6, "猫猫")]
    frame = spark.createDataFrame([(i, t, "xx", 0.0, "h", 1) for i, t in rows], SCHEMA)
    found = predict(spark, frame, model)
    assert [(i, lang) for i, lang, _ in found][:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert found[3][1] == "en" and found[3] == found[4]
    assert found[5][1] == "de"
    # unknown letters weigh the same for all: the first language, at chance
    assert found[6][1] == model.languages[0] and found[6][2] == pytest.approx(1 / len(model.languages))


def test_nothing_learned(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = langid.fit(none)
    assert model.languages == ()
    frame = spark.createDataFrame([(1, "the", None, None, None, None)], SCHEMA)
    assert predict(spark, frame, model) == [(1, "und", 0.0)]
    assert predict(spark, none, model) == []


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, f"{'wort ' * (i % 40 + 1)}{i}", "de", None, None, None) for i in range(2000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    some = langid.sample(frame, 5000).collect()
    assert 4000 < sum(len(r.text) for r in some) <= 5000
    assert {r.text for r in some} <= {r[1] for r in rows}
    assert langid.sample(frame, 10**9).count() == 2000


def test_languages_of_long_or_much_copied_texts_are_learned(spark):
    # a language of one text beyond the bound, one whose least hash is beyond it, one of copies and a few more
    rows = [("fi", "kissa " * 2000)]
    rows += [("de", f"wort{'abcdefghij'[i]} " * 2000) for i in range(10)] + [("de", f"kurz {i}") for i in range(50)]
    rows += [("en", "copied words " * 300)] * 200 + [("en", f"other text {'abcdefghij'[i % 10]}{i}") for i in range(20)]
    frame = spark.createDataFrame([(i, t, lang, None, None, None) for i, (lang, t) in enumerate(rows)], SCHEMA)
    some = langid.sample(frame, 5000).collect()
    sizes = {lang: sum(len(r.text) for r in some if r.lang == lang) for lang in ("fi", "de", "en")}
    assert all(3000 < n <= 5000 for n in sizes.values())
    assert langid.fit(frame, 5000).languages == ("de", "en", "fi")
    whole = langid.sample(frame, 10**9).collect()
    assert sum("copied" in r.text for r in whole) == 4 and sum("other" in r.text for r in whole) == 20


def test_blocks_hold_whole_words_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_CHARS", 20)
    text = "eins zwei drei vierundzwanzig, fünf 66 sechs_sieben\nacht neunundneunzig zehn."
    frame = spark.createDataFrame([(1, text, "de", None, None, None), (2, "x" * 500, "xx", None, None, None)], SCHEMA)
    rows = langid.sample(frame, 10**6).collect()
    found = sorted(w for r in rows if r.lang == "de" for w in langid.TOKEN.findall(r.text))
    assert found == sorted(langid.TOKEN.findall(text))
    assert any(r.lang == "xx" for r in rows) and all(len(r.text) <= 20 + 20 for r in rows)


def test_whole_texts_against_a_plain_version(spark, model):
    """Sum, greatest language and score of every text, word by word."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {}
    for doc, lang, score in predict(spark, docs, model):
        words = langid.TOKEN.findall((texts[doc] or "").lower())
        for w in set(words) - known.keys():
            known[w] = np.asarray(slow_word(model, w), dtype=float)
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        rows = np.array([known[w] for w in words])
        odds = np.exp(rows - rows.max(axis=1, keepdims=True))
        share = (odds / odds.sum(axis=1, keepdims=True)).mean(axis=0)
        sums = rows.sum(axis=0)
        assert sums[model.languages.index(lang)] == pytest.approx(sums.max(), rel=1e-5)
        assert score == pytest.approx(share[model.languages.index(lang)], abs=1e-4)


def test_fit_counts_the_sample(spark):
    from collections import Counter
    import re

    rows = [(1, "Das Haus, das Auto", "de"), (2, "the house the car the", "en"), (3, "ñandú the", "es"), (4, "12 -", "de"), (5, None, "en"), (6, "x", None)]
    frame = spark.createDataFrame([(i, t, lang, 0.0, "h", 1) for i, t, lang in rows], SCHEMA)
    model = langid.fit(frame)
    assert model.languages == ("de", "en", "es")
    words, grams = {}, {n: {} for n in langid.ORDERS}
    for i, lang in enumerate(model.languages):
        for w, k in Counter(w for _, t, own in rows if own == lang for w in re.findall(r"[a-zñú]+", (t or "").lower())).items():
            words.setdefault(w, [0, 0, 0])[i] += k
            marked = langid.EDGE + w + langid.EDGE
            for n in langid.ORDERS:
                for at in range(len(marked) - n + 1):
                    grams[n].setdefault(marked[at : at + n], [0, 0, 0])[i] += k
    for own, table_ in ((model.words, [words]), (model.grams, [{g: c for g, c in grams[n].items() if g != langid.EDGE} for n in langid.ORDERS])):
        assert set(own) == set().union(*table_)
        for part in table_:
            total = np.sum(list(part.values()), axis=0)
            for item, counts in part.items():
                want = np.log((np.array(counts) + langid.SMOOTH) / (total + langid.SMOOTH * len(part)))
                assert np.allclose(model.logs[own[item]], want, atol=1e-5), item
