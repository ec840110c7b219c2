"""A keyed table in hash buckets: changes are appended, reads merge them, compaction rewrites what they touched.

Below a store's folder lie ``base/generation=G/bucket=B``, ``delta/batch=N/bucket=B``
(rows put in), ``gone/batch=N/bucket=B`` (keys taken out) and ``manifest/made=G``,
which tells each bucket's generation: its rows are those of that generation and
the changes of later batches. Nothing is overwritten that a manifest names, so a
job that dies leaves the store as it was, and a batch that runs again writes the
same folder anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from logloom.functions.spread import latest
from logloom.session import drop_path, shuffle_width

BUCKETS = 64


@dataclass(frozen=True)
class KeyedStore:
    """Rows of ``schema`` (as DDL) below ``path``, one per ``key``.

    Of several rows of a key the one with the greatest ``order`` stays, on a tie
    that of the later batch, then the one with the greatest ``ties``. Null keys
    are a key like any other. Batches are numbered upwards from 1 by the caller.
    A bucket is written by one task, so ``buckets`` should grow with the table.
    """

    spark: SparkSession
    path: str
    schema: str
    key: Sequence[str]
    order: Sequence[str]
    ties: Sequence[str] = ()
    buckets: int = BUCKETS

    def create(self, rows: DataFrame) -> None:
        """The first generation, numbered 0, out of all rows."""
        nothing = rows.select(*self._columns).filter(F.lit(False))
        self._write(nothing, "delta")
        self._write(nothing.select(*self.key), "gone")
        self._write(self._last(rows), "base/generation=0")
        self._note(dict.fromkeys(range(self.buckets), 0), 0)

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Put rows in, as a delta: only buckets with a key among ``rows`` get a file, and none is read."""
        self._write(self._last(rows), f"delta/batch={batch}")

    def delete(self, keys: DataFrame, batch: int) -> None:
        """Take out what earlier batches put in under ``keys``; a later batch may put it in again."""
        self._write(keys.select(*self.key).distinct(), f"gone/batch={batch}")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows as they are now; with ``keys`` only of those, out of the buckets that can hold them."""
        state = self._state()
        if keys is None:
            return self._merged(state, state)
        asked = keys.select(*self.key).distinct()
        found = self._merged(state, self._found(asked.select(self._bucket().alias("bucket"))))
        return found.join(_renamed(asked, self.key), self._same(), "left_semi")

    def compact(self, upto: int) -> list[int]:
        """Merge the changes of batches up to ``upto`` into a new generation of the buckets they touched."""
        state = self._state()
        changes = self._later("delta", state, state, upto).select("bucket").unionByName(
            self._later("gone", state, state, upto).select("bucket")
        )
        touched = self._found(changes)
        if touched:
            self._save(self._merged(state, touched, upto, dealt=True), f"base/generation={upto}")
            self._note({**state, **dict.fromkeys(touched, upto)}, upto)
        return touched

    def vacuum(self) -> None:
        """Remove generations, changes and manifests that no bucket needs; readers of older states must be done."""
        state = self._state()
        oldest, kept = min(state.values()), set(state.values())
        newest = max(kept)
        for part, needed in (("base", kept.__contains__), ("manifest", newest.__eq__), ("delta", oldest.__lt__), ("gone", oldest.__lt__)):
            for number in self._numbers(part):
                if not needed(number):
                    drop_path(self.spark, f"{self.path}/{part}/{_NAMES[part]}={number}")

    @property
    def _columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).fieldNames()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _same(self) -> Column:
        match = F.lit(True)
        for c in self.key:
            match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return match

    def _last(self, rows: DataFrame) -> DataFrame:
        # combined before the shuffle, so a key that many rows repeat is one row of its bucket
        return latest(rows.select(*self._columns), list(self.key), [*self.order, *self.ties])

    def _write(self, rows: DataFrame, part: str) -> None:
        width = min(self.buckets, shuffle_width(self.spark))
        self._save(rows.withColumn("bucket", self._bucket()).repartition(width, "bucket"), part)

    def _save(self, dealt: DataFrame, part: str) -> None:
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{part}")

    def _note(self, state: dict[int, int], made: int) -> None:
        rows = self.spark.createDataFrame(sorted(state.items()), "bucket int, generation int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/made={made}")

    def _state(self) -> dict[int, int]:
        """Each bucket's generation, one entry per bucket."""
        newest = max(self._numbers("manifest"))
        rows = self.spark.read.schema("bucket int, generation int").parquet(f"{self.path}/manifest/made={newest}")
        return {r.bucket: r.generation for r in rows.collect()}

    def _numbers(self, part: str) -> list[int]:
        """The numbers of a part's folders that were written to the end."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        pattern = jvm.Path(f"{self.path}/{part}/{_NAMES[part]}=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return [int(f.getPath().getParent().getName().split("=")[1]) for f in found]

    def _found(self, buckets: DataFrame) -> list[int]:
        """Distinct buckets: as many as the store has at most."""
        return sorted(r.bucket for r in buckets.distinct().collect())

    def _base(self, state: dict[int, int], buckets: Iterable[int]) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, generation int, bucket int").parquet(f"{self.path}/base")
        # of partition columns alone, so other folders are not listed for reading
        return rows.filter(F.concat_ws("/", "generation", "bucket").isin([f"{state[b]}/{b}" for b in buckets]))

    def _later(self, part: str, state: dict[int, int], buckets: Iterable[int], upto: int | None = None) -> DataFrame:
        """Changes of ``buckets`` that are not in their generation yet, of batches written to the end."""
        fields = StructType([f for f in StructType.fromDDL(self.schema) if part == "delta" or f.name in self.key])
        rows = self.spark.read.schema(fields.add("batch", IntegerType()).add("bucket", IntegerType())).parquet(f"{self.path}/{part}")
        oldest = min(state.values())
        written = [n for n in self._numbers(part) if n > oldest and (upto is None or n <= upto)]
        by_generation: dict[int, list[int]] = {}
        for b in buckets:
            by_generation.setdefault(state[b], []).append(b)
        open_ = F.lit(False)
        for generation, some in by_generation.items():
            open_ = open_ | ((F.col("batch") > generation) & F.col("bucket").isin(some))
        return rows.filter(F.col("batch").isin(written) & open_)

    def _merged(self, state: dict[int, int], buckets: Iterable[int], upto: int | None = None, dealt: bool = False) -> DataFrame:
        buckets = list(buckets)
        old = self._base(state, buckets).select(*self._columns, F.lit(-1).alias("_batch"))
        new = self._later("delta", state, buckets, upto).select(*self._columns, F.col("batch").alias("_batch"))
        rows = old.unionByName(new)
        gone = self._later("gone", state, buckets, upto).groupBy(*self.key).agg(F.max("batch").alias("_gone"))
        rows = rows.join(_renamed(gone, self.key), self._same(), "left").filter("_gone is null or _batch > _gone")
        order = [*self.order, "_batch", *self.ties]
        if not dealt:
            return latest(rows.select(*self._columns, "_batch"), list(self.key), order).select(*self._columns)
        # a key has one row a batch at most, so rows go to their bucket's task as they are and are merged there, in one shuffle
        rows = rows.select(*self._columns, "_batch", self._bucket().alias("bucket"))
        rows = rows.repartition(min(self.buckets, shuffle_width(self.spark)), "bucket")
        return latest(rows, [*self.key, "bucket"], order).select(*self._columns, "bucket")


# What numbers the folders of a part
_NAMES = {"base": "generation", "manifest": "made", "delta": "batch", "gone": "batch"}


def _renamed(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    return frame.select(*[F.col(c).alias(f"_k_{c}" if c in key else c) for c in frame.columns])
