"""Exact nearest search by blocks.

Both sides are cut into blocks of bounded size by a hash of their ids; every
pair of blocks is scored in one task with numpy, which passes on only the k best
per row and block. Work is spread evenly whatever the tokens or the values are,
no pair of rows is ever shuffled, and nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
# Digits kept of a score: makes order and ties independent of the order of summation
DIGITS = 6
# Nearly equal pairs whose difference is taken at a time
CLOSE_PAIRS = 1 << 16
# Scores that a task holds at a time
AT_ONCE = 1 << 21
# Rows and columns of distances that a task holds at a time, so few that they stay in its core's cache
TILE = 1024


class Dense:
    """Scores of ``vector`` columns: ``cosine`` similarity or negative ``euclidean`` distance."""

    def __init__(self, metric: str):
        self.metric = metric

    def __call__(self, left: pd.DataFrame, right: pd.DataFrame):
        """A score for every left and right row."""
        import numpy as np

        a, b = stacked(left["vector"]), stacked(right["vector"])
        dots = a @ b.T
        a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        if self.metric == "cosine":
            return _cosine(dots, np.sqrt(np.outer(a2, b2)))
        gaps = a2[:, None] + b2[None, :] - 2 * dots
        # the expanded form loses digits where points nearly coincide
        close = np.nonzero(gaps < 1e-6 * (a2[:, None] + b2[None, :]))
        for start in range(0, len(close[0]), CLOSE_PAIRS):
            i, j = (c[start : start + CLOSE_PAIRS] for c in close)
            difference = a[i] - b[j]
            gaps[i, j] = np.einsum("ij,ij->i", difference, difference)
        return -np.sqrt(np.maximum(gaps, 0.0))

    def pairs(self, left: pd.DataFrame, right: pd.DataFrame):
        """A score for each left row with the right row beside it."""
        import numpy as np

        a, b = stacked(left["vector"]), stacked(right["vector"])
        if self.metric == "cosine":
            norms = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            return _cosine(np.einsum("ij,ij->i", a, b), norms)
        return -np.sqrt(np.einsum("ij,ij->i", a - b, a - b))


def stacked(vectors: pd.Series):
    import numpy as np

    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def _cosine(dots, norms):
    import numpy as np

    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, dots / norms, -np.inf)


def dense_scorer(metric: str) -> Dense:
    return Dense(metric)


def block_count(frame: DataFrame, rows: int = BLOCK_ROWS) -> int:
    return max(1, -(-frame.count() // rows))


def pair_blocks(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    within: Sequence[str],
    visit: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    blocks: tuple[int | Column, int | Column],
) -> DataFrame:
    """Run ``visit`` on every pair of a left and a right block (of the same ``within``).

    ``blocks`` are the numbers of blocks, or a column of both sides that holds them.
    """
    n_left, n_right = (F.lit(n) if isinstance(n, int) else n for n in blocks)
    # both sides may come from one frame: give their columns identities of their own
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    a = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), n_left).cast("int")).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), (n_right - 1).cast("int")))
    )
    b = right.withColumn("_rb", F.pmod(F.xxhash64(right_id), n_right).cast("int")).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), (n_left - 1).cast("int")))
    )
    keys = [*within, "_lb", "_rb"]
    columns = [c.split(":")[0].split()[0] for c in schema.split(",")]

    def run(_key, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        return visit(l, r)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, schema)


def slices(frame: pd.DataFrame, wide: int):
    """(start, part): parts of a frame whose rows hold ``AT_ONCE`` numbers if each has ``wide``."""
    step = max(1, AT_ONCE // max(1, wide))
    for start in range(0, len(frame), step):
        yield start, frame.iloc[start : start + step]


def squared_tiles(left, right, alone: bool):
    """(i, j, squared distances of the left points from i to the right points from j), ``TILE`` of each at a time.

    Points are the rows of arrays. Those of one set (``alone``) meet once: j is never less than i. NaN stays.
    """
    import numpy as np

    a2, b2 = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
    for i in range(0, len(left), TILE):
        a, own = left[i : i + TILE] * -2, a2[i : i + TILE, None]
        for j in range(i if alone else 0, len(right), TILE):
            gaps = a @ right[j : j + TILE].T
            gaps += own
            gaps += b2[None, j : j + TILE]
            # the expanded form loses digits where points nearly coincide
            if not gaps.min() >= 1e-6 * (own.max() + b2[j : j + TILE].max()):
                close = np.nonzero(gaps < 1e-6 * (own + b2[None, j : j + TILE]))
                for at in range(0, len(close[0]), CLOSE_PAIRS):
                    x, y = (c[at : at + CLOSE_PAIRS] for c in close)
                    difference = left[i + x] - right[j + y]
                    gaps[x, y] = np.einsum("ij,ij->i", difference, difference)
            yield i, j, gaps


class Least:
    """The ``k`` least values of each of ``n`` rows, of values that come in any order; infinite where there are fewer."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.values, self.most = k, np.full((n, k), np.inf), np.full(n, np.inf)

    def add(self, start: int, found, axis: int = 0) -> None:
        """An array whose rows, or columns for ``axis`` 1, are values for the rows from ``start``.

        Few are less than what is held, and only these are looked at.
        """
        import numpy as np

        n = found.shape[axis]
        most = self.most[start : start + n]
        places = np.flatnonzero(found < (most if axis else most[:, None]))
        if len(places) * 8 > found.size:
            rows = np.arange(start, start + n)
            joined = np.concatenate([self.values[rows], found.T if axis else found], axis=1)
            joined[np.isnan(joined)] = np.inf
        elif len(places):
            at, values = np.divmod(places, found.shape[1])[axis], found.ravel()[places]
            if axis:
                # small numbers sort in one pass
                order = np.argsort(at.astype(np.int16 if n < 1 << 15 else at.dtype), kind="stable")
                at, values = at[order], values[order]
            many = np.bincount(at, minlength=n)
            rows = np.flatnonzero(many)
            many = many[rows]
            joined = np.full((len(rows), self.k + many.max()), np.inf)
            rows += start
            joined[:, : self.k] = self.values[rows]
            joined[np.repeat(np.arange(len(rows)), many), self.k + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)] = values
        else:
            return
        # assigned, not kept: a view would hold all that was compared
        self.values[rows] = np.partition(joined, self.k - 1, axis=1)[:, : self.k]
        self.most[rows] = self.values[rows].max(axis=1)


def paired_blocks(
    points: DataFrame,
    key: str,
    within: Sequence[str],
    visit: Callable[..., Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run ``visit`` once on every unordered pair of blocks of one frame, and of a block with itself (``alone``).

    It gets the rows of both sides, their vectors as arrays and ``alone``, and yields frames. The column ``_blocks``
    holds the number of blocks. A row goes to as many tasks as there are blocks.
    """
    own = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
    rows = points.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))))
    rows = rows.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other")).drop("_other", "_blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        # vectors become arrays batch by batch, so a pair is never held in two forms
        held, alone = ([], []), True
        for some in batches:
            alone = bool(some["_lo"].iloc[0] == some["_hi"].iloc[0])
            for side, of in zip(held, ("_lo", "_hi")):
                mine = some[some["_own"] == some[of]]
                if len(mine) and not (alone and of == "_hi"):
                    side.append((mine.drop(columns=["vector", "_own", "_lo", "_hi"]), stacked(mine["vector"])))
        if not held[0] or not (alone or held[1]):
            return
        l, left = pd.concat([p[0] for p in held[0]], ignore_index=True), np.concatenate([p[1] for p in held[0]])
        held[0].clear()
        r, right = (l, left) if alone else (pd.concat([p[0] for p in held[1]], ignore_index=True), np.concatenate([p[1] for p in held[1]]))
        held[1].clear()
        yield from visit(l, r, left, right, alone)

    return rows.groupBy(*within, "_lo", "_hi").applyInPandas(run, schema)


def in_slices(frame: pd.DataFrame, rows: int = 8192) -> Iterator[pd.DataFrame]:
    """Parts of a frame, so that a task passes on few rows at a time."""
    for start in range(0, len(frame), rows):
        yield frame.iloc[start : start + rows]


def best_matches(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    scorer: Dense,
    k: int,
    within: Sequence[str] = (),
    blocks: tuple[int | Column, int | Column] | None = None,
) -> DataFrame:
    """(within, left_id, right_id, score, rank): the ``k`` best right rows of every left row.

    Scores are rounded; equal scores rank by the right id.
    """
    sizes = blocks or (block_count(left), block_count(right))
    types = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    names = [*within, left_id, right_id]
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", score double"
    digits = DIGITS

    def visit(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        r = r.sort_values(right_id, kind="stable")
        scores = np.round(scorer(l, r), digits)
        ids = r[right_id].to_numpy()
        owners, found, values = [], [], []
        for i in range(len(l)):
            row = -scores[i]
            if k < len(row):
                row_limit = np.partition(row, k - 1)[k - 1]
                picked = np.flatnonzero(row <= row_limit)
            else:
                picked = np.arange(len(row))
            picked = picked[np.isfinite(row[picked])]
            picked = picked[np.argsort(row[picked], kind="stable")][:k]
            owners.append(np.full(len(picked), i))
            found.append(ids[picked])
            values.append(scores[i][picked])
        at = np.concatenate(owners).astype(int)
        out = {n: l[n].to_numpy()[at] for n in [*within, left_id]}
        out[right_id] = np.concatenate(found)
        out["score"] = np.concatenate(values)
        return pd.DataFrame(out)

    partial = pair_blocks(left, right, left_id, right_id, within, visit, schema, sizes)
    order = Window.partitionBy(*within, left_id).orderBy(F.desc("score"), F.col(right_id))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
