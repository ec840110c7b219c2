"""The chunk table: create, upsert, delete, group, and fill from a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import latest
from logloom.functions.text import stable_id
from logloom.sinks.tables import delete

_NO_METADATA = "cast(map() as map<string,string>)"
_NO_TAGS = "cast(array() as array<string>)"


def chunk_key(requests: DataFrame) -> Column:
    """The id of a requested chunk: its own, or one made of its tracking id or content."""
    parts = [F.col(c) for c in ("tracking_id", "content") if c in requests.columns]
    made = stable_id(F.coalesce(*parts))
    return F.coalesce(F.col("chunk_id"), made) if "chunk_id" in requests.columns else made


def create_chunks(requests: DataFrame) -> DataFrame:
    """Chunk rows of (content[, metadata, tags, tracking_id, chunk_id, version]) with defaults filled."""
    have = set(requests.columns)

    def column(name: str, otherwise):
        return F.col(name) if name in have else otherwise

    tracking = column("tracking_id", F.lit(None).cast("string"))
    return requests.select(
        chunk_key(requests).alias("chunk_id"),
        "content",
        F.coalesce(column("metadata", F.expr(_NO_METADATA)), F.expr(_NO_METADATA)).alias("metadata"),
        F.coalesce(column("tags", F.expr(_NO_TAGS)), F.expr(_NO_TAGS)).alias("tags"),
        tracking.alias("tracking_id"),
        column("version", F.lit(1)).cast("bigint").alias("version"),
    )


def upsert_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks with requests merged in; the highest version of a chunk stays, on a tie the request."""
    old = chunks.withColumn("_new", F.lit(0))
    new = create_chunks(requests).withColumn("_new", F.lit(1))
    merged = old.unionByName(new).withColumn("_text", F.col("content"))
    return latest(merged, ["chunk_id"], ["version", "_new", "_text"]).select(*chunks.columns)


def delete_chunks(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(chunks, gone, ["chunk_id"])


def create_groups(requests: DataFrame) -> DataFrame:
    """Group rows of (name, description[, metadata, tag_set, tracking_id, version]) with defaults."""
    have = set(requests.columns)

    def column(name: str, otherwise):
        return F.col(name) if name in have else otherwise

    tracking = column("tracking_id", F.lit(None).cast("string"))
    version = column("version", F.lit(1)).cast("bigint")
    return requests.select(
        stable_id("name", "description", F.coalesce(tracking, F.lit("")), version).alias("group_id"),
        "name",
        "description",
        F.coalesce(column("metadata", F.expr(_NO_METADATA)), F.expr(_NO_METADATA)).alias("metadata"),
        F.coalesce(column("tag_set", F.expr(_NO_TAGS)), F.expr(_NO_TAGS)).alias("tag_set"),
        tracking.alias("tracking_id"),
        version.alias("version"),
    )


def add_groups(groups: DataFrame, requests: DataFrame, upsert: bool = False) -> DataFrame:
    """Append groups; with ``upsert`` a known tracking id keeps its group id and takes the new values."""
    made = create_groups(requests)
    if not upsert:
        return groups.unionByName(made)
    both = groups.withColumn("_new", F.lit(0)).unionByName(made.withColumn("_new", F.lit(1)))
    tracked = both.filter(F.col("tracking_id").isNotNull())
    plain = both.filter(F.col("tracking_id").isNull())
    rest = [c for c in groups.columns if c not in ("group_id", "tracking_id")]
    merged = tracked.groupBy("tracking_id").agg(
        F.min_by("group_id", F.struct("_new", "version", "group_id")).alias("group_id"),
        F.max_by(F.struct(*rest), F.struct("version", "_new", "group_id")).alias("_row"),
    )
    kept = merged.select(
        *[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in groups.columns]
    )
    return plain.select(*groups.columns).unionByName(kept)


def add_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """Membership rows (group_id, chunk_id), each once."""
    pair = ["group_id", "chunk_id"]
    return members.select(*pair).unionByName(links.select(*pair)).distinct()


def add_chunks_to_group(
    chunks: DataFrame, members: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Create chunks from requests that name a ``group_id`` and link them to it."""
    links = requests.select("group_id", chunk_key(requests).alias("chunk_id"))
    return upsert_chunks(chunks, requests.drop("group_id")), add_members(members, links)


def class_chunks(classes: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """One chunk per catalogue class, with class id, category and parent as metadata.

    ``fields`` adds one chunk per field of a class; long field lists are never
    gathered into one text.
    """
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Class: "), F.col("name").cast("string")),
        F.concat(F.lit("Category: "), F.col("category").cast("string")),
        F.concat(F.lit("Extends: "), F.col("extends").cast("string")),
        F.when(F.col("description") != "", F.col("description"))
        if "description" in classes.columns
        else F.lit(None).cast("string"),
    )
    made = classes.select(
        F.concat(F.lit("class-"), F.col("uid").cast("string")).alias("tracking_id"),
        text.alias("content"),
        F.map_filter(
            F.create_map(
                F.lit("class_uid"), F.col("uid").cast("string"),
                F.lit("category"), F.col("category").cast("string"),
                F.lit("extends"), F.col("extends").cast("string"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("metadata"),
        F.array_compact(F.array(F.lit("class"), F.col("category").cast("string"))).alias("tags"),
    )
    if fields is not None:
        made = made.unionByName(
            fields.select(
                F.concat_ws("-", F.lit("field"), F.col("class_uid").cast("string"), F.col("pos").cast("string")).alias("tracking_id"),
                F.concat_ws(
                    "\n",
                    F.concat(F.lit("Field: "), F.col("name")),
                    F.concat(F.lit("Type: "), F.col("type")),
                    F.concat(F.lit("Class: "), F.col("class_uid").cast("string")),
                ).alias("content"),
                F.create_map(F.lit("class_uid"), F.col("class_uid").cast("string")).alias("metadata"),
                F.array(F.lit("field")).alias("tags"),
            )
        )
    return create_chunks(made)


def changed_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh chunks whose text the table does not hold yet: the daily refresh."""
    return fresh.withColumn("_h", F.sha2("content", 256)).join(
        chunks.select("chunk_id", F.sha2("content", 256).alias("_h")), ["chunk_id", "_h"], "left_anti"
    ).drop("_h")
