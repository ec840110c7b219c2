"""Scans of the search-query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import first_n, lookup
from logloom.session import shuffle_width

# Fixed value: age of the clustering scan
RECENT_DAYS = 7
# (dataset, day) pairs up to which their list is broadcast, at some hundred bytes each
PAIRS = 100_000
# Datasets without a mark up to which their folders are chosen by name
NAMES = 1_000


def datasets(searches: DataFrame) -> DataFrame:
    return searches.select("dataset_id").distinct()


def first_scan(searches: DataFrame) -> DataFrame:
    """Rows of a first run: not yet marked, not from answer generation."""
    return searches.filter((F.col("is_duplicate") == 0) & (F.col("search_type") != "rag"))


def marks(state: DataFrame) -> DataFrame:
    """Latest high-water mark of each dataset."""
    return state.groupBy("dataset_id").agg(
        F.max_by("last_collapsed", "created_at").alias("last_collapsed")
    )


def since_marks(searches: DataFrame, mark_table: DataFrame) -> DataFrame:
    """Rows to collapse now: of datasets with a mark those at or after it, of others as in a first run.

    The least mark is read first and reaches the scan as a constant, so rows and
    files older than every mark are skipped. Datasets without a mark are scanned
    apart, for their unmarked rows only.
    """
    known = mark_table.filter(F.col("last_collapsed").isNotNull()).select("dataset_id", "last_collapsed")
    kept = searches.filter(F.col("search_type") != "rag")
    fresh = lookup(kept.filter(F.col("is_duplicate") == 0), known.select("dataset_id"), ["dataset_id"], ["id"], how="left_anti")
    least = known.agg(F.min("last_collapsed")).first()[0]
    if least is None:
        return fresh.select(*searches.columns)
    newer = lookup(kept.filter(F.col("created_at") >= F.lit(least)), known, ["dataset_id"], ["id"], how="inner")
    newer = newer.filter(F.col("created_at") >= F.col("last_collapsed")).select(*searches.columns)
    return newer.unionByName(fresh.select(*searches.columns))


def land_by_day(searches: DataFrame, path: str) -> DataFrame:
    """Append searches to a log in folders of dataset and day (UTC); the log as it is then.

    Rows are dealt by dataset, day and a hash of the id, so a busy day is written by several tasks.
    An empty dataset name is read back as null, as folder names cannot tell them apart.
    """
    day = F.date_from_unix_date(F.floor(F.col("created_at") / 86_400).cast("int"))
    width = shuffle_width(searches.sparkSession)
    dealt = searches.withColumn("day", day).repartition(width, "dataset_id", "day", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.write.mode("append").partitionBy("dataset_id", "day").parquet(path)
    return read_by_day(searches, path)


def read_by_day(like: DataFrame, path: str) -> DataFrame:
    """The log below ``path`` with the columns of ``like`` and ``day``, whose types are not guessed from folder names."""
    return like.sparkSession.read.schema(like.withColumn("day", F.lit(None).cast("date")).schema).parquet(path)


def since_marks_by_day(log: DataFrame, mark_table: DataFrame) -> DataFrame:
    """:func:`since_marks` on a log in folders: of each dataset only the days from its own mark on are read.

    Days up to the newest mark are joined as pairs of day and dataset, which prune the
    folders while the job runs, if there are few enough of them to broadcast; later days
    are chosen by a constant, datasets without a mark by name, if they are few. A dataset
    that ran last long ago costs its own days alone.
    """
    known = mark_table.filter(F.col("last_collapsed").isNotNull()).select("dataset_id", "last_collapsed")
    kept = log.filter(F.col("search_type") != "rag")
    columns = [c for c in log.columns if c != "day"]
    fresh = kept.filter(F.col("is_duplicate") == 0)
    # a folder name each: no column of the files is read for it
    unmarked = [r.dataset_id for r in datasets(log).join(known, "dataset_id", "left_anti").limit(NAMES + 1).collect()]
    if len(unmarked) <= NAMES:
        named = F.col("dataset_id").isin([d for d in unmarked if d is not None])
        fresh = fresh.filter(named | F.col("dataset_id").isNull() if None in unmarked else named)
    else:
        fresh = lookup(fresh, known.select("dataset_id"), ["dataset_id"], ["id"], how="left_anti")
    newest = known.agg(F.max("last_collapsed")).first()[0]
    if newest is None:
        return fresh.select(*columns)

    def day_of(second: Column) -> Column:
        return F.date_from_unix_date(F.floor(second / 86_400).cast("int"))

    # pruning takes each join key by itself, so the folder is one key; a day's text is of fixed length
    folder = F.concat_ws("/", "day", "dataset_id")
    last = day_of(F.lit(newest))
    days = F.explode(F.sequence(day_of(F.col("last_collapsed")), last)).alias("day")
    pairs = known.select("dataset_id", "last_collapsed", days).filter(F.col("day") <= last)
    pairs = pairs.select(folder.alias("_folder"), "last_collapsed")
    older = kept.filter((F.col("day") <= last) & F.col("dataset_id").isNotNull()).withColumn("_folder", folder)
    if pairs.limit(PAIRS + 1).count() <= PAIRS:
        older = older.join(F.broadcast(pairs), "_folder")
    else:
        older = lookup(older, pairs, ["_folder"], ["id"], how="inner")
    older = older.filter(F.col("created_at") >= F.col("last_collapsed"))
    # a day after every mark is behind none
    later = lookup(kept.filter(F.col("day") > last), known.select("dataset_id"), ["dataset_id"], ["id"], how="inner")
    return older.select(*columns).unionByName(later.select(*columns)).unionByName(fresh.select(*columns))


def recent(searches: DataFrame, as_of: Column, days: int = RECENT_DAYS) -> DataFrame:
    """All unmarked searches of the last ``days``."""
    return searches.filter((F.col("created_at") >= as_of - days * 86_400) & (F.col("is_duplicate") == 0))


def vector_sample(
    searches: DataFrame,
    as_of: Column,
    n: int,
    days: int = RECENT_DAYS,
    seed: str = "0",
) -> DataFrame:
    """At most ``n`` recent unmarked searches of each dataset, chosen by a seeded hash of the id."""
    shuffled = recent(searches, as_of, days).withColumn("_key", F.md5(F.concat(F.col("id"), F.lit(seed))))
    picked = first_n(shuffled, ["dataset_id"], [F.col("_key"), F.col("id")], n, ["id"])
    return picked.drop("_key", "rank")


def enough(sample: DataFrame, at_least: int = 30) -> DataFrame:
    """Drop datasets with fewer rows than a cluster needs."""
    sizes = sample.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") >= at_least).select("dataset_id")
    return lookup(sample, large, ["dataset_id"], ["id"], how="left_semi")
