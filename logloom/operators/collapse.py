"""Collapse of keystroke prefixes in a search-query log.

Input rows: ``id``, ``dataset_id``, ``query``, ``created_at`` (epoch seconds).
Both operators return the (``dataset_id``, ``id``) to mark as duplicates, so wide
columns such as vectors and results stay out of their shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.spread import lookup_large, with_ordinal
from logloom.functions.text import related, squash

# Rows looked at on either side, and seconds between related queries
LOOK_RANGE = 10
TIME_WINDOW = 10

# Rows per window block of the neighbour mode, seconds per window block of the later mode, and
# seconds over which the lengths of queries are gathered
BLOCK_ROWS = 10_000
BLOCK_SECONDS = 3600
LENGTH_SECONDS = 60


def ordered(searches: DataFrame) -> DataFrame:
    """Number the searches of each dataset by time, byte length and id."""
    return with_ordinal(
        searches,
        ["dataset_id"],
        [F.col("created_at"), F.octet_length("query"), F.col("id")],
    )


def superseded(searches: DataFrame, seconds: int = TIME_WINDOW) -> DataFrame:
    """Searches that a later one within ``seconds`` extends or repeats.

    A search is judged by its text and time only, so copies are reduced first,
    and no pair of searches is ever formed. Every distinct (text, time) is sent
    to those prefixes of its text that are as long as some query of the dataset
    at about that time, as digests of them. For each prefix and time the greatest order key arriving there is kept; the
    prefix is superseded at time t if something arrives after t within the
    window, or at t with a greater order key. Windows run over blocks of time, no
    shorter than ``seconds`` and each a bounded number of distinct times, with the
    start of the next block copied in. Times are whole seconds.
    """
    if dict(searches.dtypes)["created_at"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("created_at must be whole seconds")
    width = max(BLOCK_SECONDS, seconds)
    rows = searches.select(
        "dataset_id",
        "id",
        squash("query").alias("q"),
        F.col("created_at").alias("t"),
        F.struct(F.octet_length("query").alias("len"), F.col("id").alias("id")).alias("key"),
    )
    texts = rows.groupBy("dataset_id", "q", "t").agg(F.max("key").alias("key"))
    minute, last = _block("t", LENGTH_SECONDS), _block(F.col("t") + seconds, LENGTH_SECONDS)
    # lengths of the queries of a minute and of the seconds before it: no more than a text has characters
    lengths = (
        texts.select(
            "dataset_id", F.char_length("q").alias("n"), F.explode(F.sequence(minute, last)).alias("minute")
        )
        .groupBy("dataset_id", "minute")
        .agg(F.collect_set("n").alias("_lengths"))
    )
    near = lookup_large(
        texts.withColumn("minute", minute), lengths, ["dataset_id", "minute"], ["q", "t"], how="inner"
    )
    arrivals = (
        near.withColumn(
            "_n", F.explode(F.filter("_lengths", lambda n: n <= F.char_length("q")))
        )
        .select(
            "dataset_id",
            # 128 bits stand for the prefix, so what is shuffled grows with the number of lengths, not with their sum
            F.unhex(F.md5(F.expr("substr(q, 1, _n)"))).alias("prefix"),
            "t",
            "key",
            F.when(F.col("_n") == F.char_length("q"), F.col("key")).alias("own"),
        )
        .groupBy("dataset_id", "prefix", "t")
        .agg(F.max("key").alias("key"), F.max("own").alias("own"))
    )
    block = _block("t", width)
    early = F.col("t") - block * width < seconds
    blocks = arrivals.withColumn(
        "block", F.explode(F.when(early, F.array(block, block - 1)).otherwise(F.array(block)))
    )
    following = Window.partitionBy("dataset_id", "prefix", "block").orderBy("t")
    kept = (
        blocks.withColumn("next", F.lead("t").over(following))
        .filter(F.col("own").isNotNull() & (F.col("block") == block))
        .filter(F.col("next").isNull() | (F.col("next") - F.col("t") > seconds))
        .filter(F.col("key") == F.col("own"))
        .select("dataset_id", F.col("own.id").alias("id"))
    )
    return rows.select("dataset_id", "id").join(kept, ["dataset_id", "id"], "left_anti")


def _block(seconds, width: int) -> Column:
    t = seconds if isinstance(seconds, Column) else F.col(seconds)
    return F.floor(t / width).cast("bigint")


def neighbour_marks(
    searches: DataFrame,
    look_range: int = LOOK_RANGE,
    seconds: int = TIME_WINDOW,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Searches marked by comparing each with its neighbours in order.

    A search with a related and longer neighbour near in time is marked itself;
    one with related but no longer neighbours marks all related rows in range,
    whatever their time. Equal queries near in time therefore mark each other.

    Rows are cut into blocks by their number, with ``look_range`` rows of the
    adjoining blocks copied in, so a large dataset spreads over many tasks.
    """
    if block_rows < look_range:
        raise ValueError("a block must hold the look range")
    numbered = ordered(searches.select("dataset_id", "id", "query", "created_at"))
    place = F.col("ordinal") - 1
    home = F.floor(place / block_rows).cast("bigint")
    spans = F.array_distinct(
        F.array(
            home,
            F.floor((place - look_range) / block_rows).cast("bigint"),
            F.floor((place + look_range) / block_rows).cast("bigint"),
        )
    )
    blocks = numbered.select(
        "dataset_id",
        F.explode(spans).alias("block"),
        home.alias("home"),
        F.col("ordinal").alias("i"),
        F.col("created_at").alias("t"),
        squash("query").alias("q"),
    )
    around = (
        Window.partitionBy("dataset_id", "block")
        .orderBy("i")
        .rowsBetween(-look_range, look_range)
    )
    seen = (
        blocks.withColumn("_near", F.collect_list(F.struct("i", "t", "q")).over(around))
        .filter(F.col("block") == F.col("home"))
        .withColumn(
            "_kin",
            F.filter("_near", lambda r: (r["i"] != F.col("i")) & related(r["q"], F.col("q"))),
        )
        .withColumn("_close", F.filter("_kin", lambda r: F.abs(r["t"] - F.col("t")) <= seconds))
    )
    longer = F.exists("_close", lambda r: F.char_length(r["q"]) > F.char_length("q"))
    marks = (
        F.when(F.size("_close") == 0, F.expr("array()").cast("array<bigint>"))
        .when(longer, F.array("i"))
        .otherwise(F.transform("_kin", lambda r: r["i"]))
    )
    marked = seen.select("dataset_id", F.explode(marks).alias("ordinal")).distinct()
    return numbered.join(marked, ["dataset_id", "ordinal"], "left_semi").select("dataset_id", "id")
