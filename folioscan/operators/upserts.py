"""Keyed replacement as pure functions: (old table, new rows) -> new table.

Every one is idempotent: applying the same rows twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan import schemas


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row that sorts first per key."""
    window = W.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(window))
        .filter(F.col("_row") == 1).drop("_row")
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-row replacement; `new` has one row per key."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def complete_documents(new: DataFrame) -> DataFrame:
    """All document columns; absent ones are null, status and source default."""
    columns = []
    for field in schemas.DOCUMENTS:
        value = F.col(field.name) if field.name in new.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name == "status":
            value = F.coalesce(value, F.lit("active"))
        if field.name == "source":
            value = F.coalesce(value, F.lit("local"))
        columns.append(value.alias(field.name))
    return new.select(*columns)


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace documents by doc_id; a known summary outlives a row without one."""
    known = old.select("doc_id", F.col("summary").alias("_known"))
    merged = (
        complete_documents(new).join(known, "doc_id", "left")
        .withColumn("summary", F.coalesce("summary", "_known")).drop("_known")
    )
    return upsert(old, merged, ["doc_id"])


def replace_by_document(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace all rows of the touched documents, also when nothing replaces them."""
    kept = old.join(touched.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(new.select(*old.columns))


def metadata_rows(metadata: DataFrame) -> DataFrame:
    """(doc_id, map) to one row per entry."""
    return metadata.select("doc_id", F.explode("metadata").alias("key", "value"))


def tag_rows(tags: DataFrame) -> DataFrame:
    """(doc_id, array) to one row per distinct tag."""
    return tags.select("doc_id", F.explode(F.array_distinct("tags")).alias("tag"))


def update_summaries(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    """Set the summary of the listed documents; a null summary changes nothing."""
    new = summaries.select("doc_id", F.col("summary").alias("_new"))
    return (
        documents.join(new, "doc_id", "left")
        .withColumn("summary", F.coalesce("_new", "summary"))
        .select(*documents.columns)
    )


def latest_versions(documents: DataFrame) -> DataFrame:
    """The newest document per (source, source_id); rows without an id all stay."""
    named = documents.filter(F.col("source_id").isNotNull())
    newest = last_per_key(
        named, ["source", "source_id"],
        [F.col("ingested_at").desc_nulls_last(), F.col("doc_id")],
    )
    return newest.unionByName(documents.filter(F.col("source_id").isNull()))


def existing_versions(documents: DataFrame, source: str) -> DataFrame:
    """(source_id, source_modified) of one source."""
    return latest_versions(
        documents.filter((F.col("source") == source) & F.col("source_id").isNotNull())
    ).select("source_id", "source_modified")


def new_or_changed(listing: DataFrame, versions: DataFrame) -> DataFrame:
    """Listed files whose version the catalog does not have."""
    known = versions.select("source_id", "source_modified")
    return listing.join(known, ["source_id", "source_modified"], "left_anti")


def set_meta(old: DataFrame, key: str, value: str) -> DataFrame:
    """Setting table with one key set."""
    row = old.sparkSession.createDataFrame([(key, value)], schemas.CATALOG_META)
    return upsert(old, row, ["key"])


def lock_value(old: DataFrame, key: str, requested: str) -> DataFrame:
    """Setting table in which `key` keeps its value, or takes `requested` once."""
    row = old.sparkSession.createDataFrame([(key, requested)], schemas.CATALOG_META)
    return old.unionByName(row.join(old.select("key"), "key", "left_anti"))


def drop_legacy_columns(chunks: DataFrame) -> DataFrame:
    """Chunk table without the vector column of early catalogs."""
    return chunks.drop("embedding")
