"""Decisions on a listing of remote files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions import keys
from folioscan.functions import text as tx


def _export(mime: Column, field: int) -> Column:
    table = F.create_map(*[
        F.lit(x) for mime_type, target in settings.EXPORT_TARGETS.items()
        for x in (mime_type, target[field])
    ])
    return F.try_element_at(table, mime)


def export_type(mime: Column) -> Column:
    """Format a native document is exported to; null for ordinary files."""
    return _export(mime, 0)


def staged_name(file_id: Column, name: Column, mime: Column) -> Column:
    """File name to stage under; null when the file is not supported."""
    base = F.concat(file_id, F.lit("__"), tx.safe_file_name(name))
    return (
        F.when(_export(mime, 1).isNotNull(), F.concat(base, _export(mime, 1)))
        .when(tx.source_type(tx.extension(name)).isNotNull(), base)
    )


def clean_listing(listing: DataFrame) -> DataFrame:
    """Listing with the markers of missing values turned into nulls."""
    return listing.select(*[tx.missing_to_null(F.col(c)).alias(c) for c in listing.columns])


def plan_listing(listing: DataFrame, versions: DataFrame) -> DataFrame:
    """Classify listed files (id, name, mime, modified) and complete their items.

    `versions` is (source_id, source_modified) of the catalog. Folders and rows
    without an id are dropped; `status` is unsupported, unchanged or staged.
    """
    files = listing.filter(
        F.col("id").isNotNull() & (F.col("id") != "")
        & (F.coalesce("mime", F.lit("")) != settings.FOLDER_MIME)
    ).withColumn("source_modified", F.coalesce("modified", F.lit("")))
    name = F.coalesce(F.nullif("name", F.lit("")), "id")
    known = versions.select(
        F.col("source_id").alias("id"), F.col("source_modified").alias("_known")
    )
    return (
        files.withColumn("filename", staged_name(F.col("id"), name, F.coalesce("mime", F.lit(""))))
        .join(known, "id", "left")
        .select(
            F.col("id").alias("source_id"), "name", F.col("mime").alias("mime_type"),
            "source_modified", "filename", export_type(F.col("mime")).alias("export_type"),
            F.concat(F.lit(settings.REMOTE_URI_PREFIX), "id").alias("source_uri"),
            keys.document_id(F.col("id"), F.col("source_modified")).alias("doc_id"),
            F.when(F.col("filename").isNull(), "unsupported")
            .when(F.col("_known") == F.col("source_modified"), "unchanged")
            .otherwise("staged").alias("status"),
        )
    )


def listing_totals(planned: DataFrame) -> DataFrame:
    """One row: files listed, staged, unchanged and unsupported."""
    return planned.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in ("staged", "unchanged", "unsupported")
        ],
    )
