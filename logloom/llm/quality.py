"""A text quality classifier by compression.

Two zstandard dictionaries are trained, on blocks of good and of bad labelled
text. A text is compressed with both, block by block so that its own history
does not drown the dictionary; the difference of the two sizes over the size of
the text, mapped by a logistic curve fitted on other labelled rows, is its score.
(Over the sum of the sizes, repetitive text, tiny under both, would score by chance.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import cut_lineage

BLOCK = 1024
LEVEL = 3
DICTIONARY = 64 << 10
# Bounds of the fitted sample, per class: rows drawn, and blocks of dictionary text
SAMPLE_ROWS = 3000
SAMPLE_BLOCKS = 4000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float


def difference(texts: Iterator[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """(bad - good) / size of the compressed sizes; 0 for an empty or null text."""
    sizes = []
    sides = []
    for content in (good, bad):
        # too little text for a trained dictionary leaves raw history, or none
        kind = zstandard.DICT_TYPE_AUTO if content[:4] == zstandard_magic() else zstandard.DICT_TYPE_RAWCONTENT
        shared = zstandard.ZstdCompressionDict(content, dict_type=kind) if len(content) >= 8 else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        sides.append(
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        pieces = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes.append([*(sum(len(side.compress(p)) for p in pieces) for side in sides), max(1, len(raw))])
    good_size, bad_size, size = np.array(sizes, dtype=float).reshape(-1, 3).T
    return (bad_size - good_size) / size


def zstandard_magic() -> bytes:
    return (0xEC30A437).to_bytes(4, "little")


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; their plain text where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic fit, in the scale of ``x`` barely held to 0; Newton's method."""
    if not len(x):
        return 0.0, 0.0
    middle, scale = np.average(x, weights=weight), x.std() or 1.0
    basis = np.stack([(x - middle) / scale, np.ones_like(x)], axis=1)
    at = np.zeros(2)
    held = np.diag([1e-6, 1e-6]) * max(1.0, weight.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(basis @ at, -30, 30)))
        gradient = basis.T @ (weight * (p - y)) + held @ at
        curve = (basis * (weight * p * (1 - p))[:, None]).T @ basis + held
        step = np.linalg.solve(curve, gradient)
        at -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0] / scale), float(at[1] - at[0] * middle / scale)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, blocks: int = SAMPLE_BLOCKS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Draws up to about ``rows`` labels per class by a hash of the id: one half for
    the dictionaries, of which up to ``blocks`` blocks a class are used, the
    other half to calibrate. Calibration weighs the classes as all labels do.
    Labels that are null, neither 0 nor 1, or without a document are passed over.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(
        "quality in (0, 1) and doc_id is not null"
    )
    sizes = {r.quality: r.n for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    drawn = marks.withColumn("place", place)
    share = F.when(F.col("quality") == 1, rows / max(1, sizes.get(1, 0))).otherwise(rows / max(1, sizes.get(0, 0)))
    # about 2 * rows rows of two numbers: bounded whatever the tables hold
    drawn = drawn.filter(F.col("place") < share * (1 << 30)).dropDuplicates(["doc_id", "quality"])
    sample = cut_lineage(
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .select("doc_id", "text", "quality", (F.col("place") % 2).alias("half"))
    )
    texts = sample.filter("half = 0 and length(text) > 0")
    cut = F.transform(
        F.sequence(F.lit(1), F.length("text"), F.lit(BLOCK)), lambda i: F.substring(F.col("text"), i, F.lit(BLOCK))
    )
    pieces = texts.select("quality", F.explode(cut).alias("piece")).withColumn("h", F.xxhash64("piece"))
    content = {}
    for side in (0, 1):
        some = pieces.filter(F.col("quality") == side).orderBy("h", "piece").limit(blocks).collect()
        content[side] = trained([r.piece.encode("utf-8", "surrogatepass")[:BLOCK] for r in some])
    good, bad = content[1], content[0]
    points = sample.filter("half = 1").select("quality", contrast(F.col("text"), good, bad).alias("x")).toPandas()
    counts = points["quality"].value_counts()
    total = max(1, sum(sizes.values()))
    weight = points["quality"].map(lambda q: sizes[q] / total / counts[q]).to_numpy(dtype=float) * len(points)
    slope, shift = logistic(points["x"].to_numpy(dtype=float), points["quality"].to_numpy(dtype=float), weight)
    return Model(good, bad, slope, shift)


def contrast(text: Column, good: bytes, bad: bytes) -> Column:
    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(difference(part.tolist(), good, bad))

    return of(text)


def score(text: Column, model: Model) -> Column:
    """The calibrated score from 0 to 1 of a whole text; empty and null texts get the curve's value at 0."""
    x = contrast(text, model.good, model.bad)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x * F.lit(model.slope) + F.lit(model.shift))))
