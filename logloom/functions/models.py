"""Arrow UDFs around text models: vectors of texts and scores of text pairs.

Models are plug-ins: a function over a batch of texts. The built-in ones need no
weights. A model is made once per worker task by its factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a search query is prefixed with before it is encoded
QUERY_PROMPT = "Search for "

Encoder = Callable[[list[str]], list]
PairModel = Callable[[list[tuple[str, str]]], list]


def hashing_encoder(dimensions: int = 64) -> Callable[[], Encoder]:
    """Signed token hashing, unit length."""

    def make() -> Encoder:
        import hashlib

        import numpy as np

        def encode(texts: list[str]) -> list:
            out = []
            for text in texts:
                vector = np.zeros(dimensions)
                for token in text.lower().split():
                    code = int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[8:], "little")
                    vector[(code >> 1) % dimensions] += 1.0 if code & 1 else -1.0
                length = float(np.sqrt((vector * vector).sum()))
                out.append(vector / length if length > 0 else vector)
            return out

        return encode

    return make


def overlap_model() -> Callable[[], PairModel]:
    """Share of the distinct query tokens that the content holds."""

    def make() -> PairModel:
        def score(pairs: list[tuple[str, str]]) -> list:
            out = []
            for query, content in pairs:
                asked = set(query.lower().split())
                out.append(len(asked & set(content.lower().split())) / len(asked) if asked else 0.0)
            return out

        return score

    return make


def embed(
    frame: DataFrame,
    text: str,
    make: Callable[[], Encoder] | None = None,
    prompt: str = QUERY_PROMPT,
    vector: str = "vector",
    status: str = "embed_status",
) -> DataFrame:
    """Add the vector of ``text``. An empty text has none; a failing batch is tried text by text
    and a text that fails gets no vector and the status ERROR."""
    factory = make or hashing_encoder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            texts = [None if t is None else t.strip() for t in batch]
            usable = [i for i, t in enumerate(texts) if t]
            vectors: list = [None] * len(texts)
            try:
                found = model([prompt + texts[i] for i in usable])
            except Exception:
                found = []
                for i in usable:
                    try:
                        found.append(model([prompt + texts[i]])[0])
                    except Exception:
                        found.append(None)
            for i, v in zip(usable, found):
                vectors[i] = v
            yield pd.Series(vectors, dtype=object)

    empty = F.coalesce(F.regexp_replace(F.col(text), r"(?U)\s+", "") == "", F.lit(True))
    state = F.when(empty, "EMPTY").when(F.col(vector).isNull(), "ERROR").otherwise("OK")
    return frame.withColumn(vector, run(F.col(text))).withColumn(status, state)


def pair_scores(
    frame: DataFrame,
    query: str,
    content: str,
    make: Callable[[], PairModel] | None = None,
    name: str = "cross_encoder_score",
) -> DataFrame:
    """Add the model's score of each (query, content); null where the model fails."""
    factory = make or overlap_model()

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for queries, contents in batches:
            pairs = [(q or "", c or "") for q, c in zip(queries, contents)]
            try:
                scores = [float(s) for s in model(pairs)]
            except Exception:
                scores = []
                for pair in pairs:
                    try:
                        scores.append(float(model([pair])[0]))
                    except Exception:
                        scores.append(None)
            yield pd.Series(scores, dtype="float64")

    return frame.withColumn(name, run(F.col(query), F.col(content)))
