"""A corpus pipeline of five operators; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import credentials, decontaminate, langid, sentencepieces, simhash
from logloom.llm.common import fresh, held_out, small_if_measured, table
from logloom.llm.queries import piece_model
from logloom.session import cut_lineage, scratch_path

# A text whose words speak for its language less than this on average is rejected
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: null texts, texts without letters and undecided ones go."""
    model = langid.fit(table(spark, sf_dir, "documents").filter(~held_out()))
    name = fresh(docs, "found")
    found = docs.withColumn(name, langid.detect(F.col("text"), model, spark))
    clear = (F.col(f"{name}.lang") != langid.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(clear).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash group, of those with the smallest id.

    Of rows that repeat that id the one with the least text hash stays, and one
    of equal ones. Rows without an id cannot be told apart and stay.
    """
    key = fresh(docs, "row")
    keyed = cut_lineage(docs.withColumn(key, F.struct(F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))))
    groups = simhash.near_groups(keyed, width=4, bits=4, row_col=key).filter("id is not null")
    kept = groups.groupBy("group_fp").agg(F.min(F.struct("id", key)).alias("first")).select(f"first.{key}")
    dropped = cut_lineage(groups.select(key).join(kept, key, "left_anti"))
    return keyed.join(small_if_measured(dropped, 32), key, "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark passage occurs."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in a text by a mark. All documents stay; ``n_chars`` follows the text."""
    clean = credentials.redacted(docs, credentials.spans(docs))
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(clean.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the piece ids of every text, and whether they decode to it."""
    done = fresh(docs, "pieces")
    rows = docs.withColumn(done, sentencepieces.round_trip(F.col("text"), piece_model()))
    return rows.select(
        *docs.columns,
        F.col(f"{done}.ids").alias(fresh(docs, "ids")),
        F.size(f"{done}.ids").cast("bigint").alias(fresh(docs, "n_ids")),
        F.col(f"{done}.exact").alias(fresh(docs, "exact")),
    )


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
