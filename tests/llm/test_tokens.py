import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from logloom.llm import tokens
from logloom.llm.common import table
from logloom.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, word string, n int, kind int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def texts():
    random.seed(9)
    out = [None, "", " ", "\n\n x", "a<|endoftext|><|endoftext|> b", "!!<|endoftext|>'s", "<|endoftext", "it's we'LL '", "the " * 30_000, "x" * 50_000, "½²Ⅷ٣", "\x1c\x85　 a"]
    for _ in range(400):
        out.append("".join(random.choices(["a", "the", " ", "  ", "\n", "\t", "'s", "'", "12", "½", "é", "中", "<|endoftext|>", "!", "\x1c", " ", "​", "_", "\U0001f600"], k=random.randrange(25))))
    return out


def test_counts_are_the_librarys(spark, library):
    rows = list(enumerate(texts())) + [(3, "twice"), (3, "twice"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, tokens.token_counts(frame, TOKENIZER).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), count(library, t)) for i, t in rows), key=repr)


def test_blocks_and_partial_sums(spark, library, monkeypatch):
    # executed in worker processes: the small limits travel with the function's module only if set there, so
    # the packing is tested here and the blocks through many partitions
    rows = [(i, t, "w", 1, 2) for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(13)
    got = {r.id: r.n_tokens for r in tokens.token_counts(frame, TOKENIZER).collect()}
    assert got == {r[0]: count(library, r[1]) for r in rows}


def test_packing_keeps_large_counts():
    at, n = np.array([3, 9, 500]), np.array([255, 70_000, 256])
    entries, taken = tokens.packed(at, n)
    places = entries[:, 0] + 256 * entries[:, 1].astype(int)
    total = np.bincount(places, weights=entries[:, 2])
    assert taken.tolist() == [1, 275, 2]
    assert (total[3], total[9], total[500], total.sum()) == (255, 70_000, 256, n.sum())


def test_counts_of_many_bits_take_several_entries():
    unit, owner, count = tokens.split_counts(np.array([4, -1]), np.array([0, 1]), np.array([3, 17]), bits=3)
    assert (unit.tolist(), owner.tolist(), count.tolist()) == ([4, -1, -1, -1], [0, 1, 1, 1], [3, 7, 7, 3])


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), TOKENIZER).collect() == []


def test_given_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.token_counts(docs, TOKENIZER).collect():
        assert r.n_tokens == count(library, text[r.id])


def test_blocks_closed_inside_a_partition(spark, library, monkeypatch):
    """Small limits, which travel with the functions that tasks run: many blocks per partition, units and sums passed on early."""
    for name, value in (("PAIRS", 40), ("DOCUMENTS", 7), ("UNITS", 5), ("SUMS", 3)):
        monkeypatch.setattr(tokens, name, value)
    rows = [(i, t, "w", 1, 2) for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with open(TOKENIZER, encoding="utf-8") as f:
        spec = f.read()
    blocks = tokens.frequencies(frame, spec, "doc_id", "text").select("block").distinct().collect()
    assert len(blocks) > len(rows) / 7 and any(r.block & 0xFFFFFFFF > 5 for r in blocks)
    got = {r.id: r.n_tokens for r in tokens.token_counts(frame, TOKENIZER).collect()}
    assert got == {r[0]: count(library, r[1]) for r in rows}
