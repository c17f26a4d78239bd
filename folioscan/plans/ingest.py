"""Ingest: from files to documents, chunks, metadata, tags and index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.operators import lexical, tags, upserts
from folioscan.operators.joins import is_small
from folioscan.operators.model_calls import ModelFactory
from folioscan.sources.catalog import Catalog
from folioscan.sources.files import (
    ContentReader, Extracted, extract, folder_content, list_folder,
)
from folioscan.sources.shared import checkpointed

STEMMER_SETTING = "stemmer"


@dataclass
class IngestTotals:
    """Outcome of one run."""

    documents: int
    chunks: int
    failed: int
    rejects: DataFrame


def document_rows(listing: DataFrame, info: DataFrame, effort: str | None = None) -> DataFrame:
    """Catalog rows of extracted files."""
    profile = settings.effort_profile(effort)
    return upserts.complete_documents(
        listing.join(info, "doc_id")
        .withColumn("path", F.coalesce("source_uri", "local_path"))
        .withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
        .withColumn("effort", F.lit(profile.name))
        .withColumn("status", F.lit("active"))
    )


def superseded(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Stored documents of which a newer version arrives."""
    arriving = new.select("source", "source_id", F.col("doc_id").alias("_new"))
    return (
        documents.select("source", "source_id", "doc_id")
        .join(arriving, ["source", "source_id"])
        .filter(F.col("doc_id") != F.col("_new")).select("doc_id").distinct()
    )


def ingest(
    catalog: Catalog,
    listing: DataFrame,
    content: ContentReader,
    effort: str | None = None,
    enrich: bool = True,
    keep_history: bool = False,
    stemmer: str | None = "porter",
    transcribe: ModelFactory | None = None,
    summarise: ModelFactory | None = None,
    tag: ModelFactory | None = None,
    pages: DataFrame | None = None,
    sheets: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> IngestTotals:
    """Add or replace the documents of a listing.

    Running it again over the same files changes nothing. An older version of a
    file leaves the catalog unless `keep_history` is set.
    """
    stemmer = catalog.lock(STEMMER_SETTING, stemmer or "none")
    found = extract(listing, content, effort, transcribe, pages, sheets, blocks)
    return store_extracted(
        catalog, listing, found, effort, enrich, keep_history,
        None if stemmer == "none" else stemmer, summarise, tag,
    )


def store_extracted(
    catalog: Catalog,
    listing: DataFrame,
    found: Extracted,
    effort: str | None,
    enrich: bool,
    keep_history: bool,
    stemmer: str | None,
    summarise: ModelFactory | None,
    tag: ModelFactory | None,
) -> IngestTotals:
    """Write extracted documents and everything derived from them.

    All tables are one change: a run that dies before its commit leaves nothing behind,
    and its files are still unknown to the next one.
    """
    documents = checkpointed(document_rows(listing, found.info, effort))
    touched = documents.select("doc_id")
    if not keep_history:
        touched = touched.union(superseded(catalog.table("documents"), documents))
    touched = checkpointed(touched.distinct())
    known = catalog.table("documents").join(touched, "doc_id", "left_semi")
    # All rows of a document come with it, so only known documents have rows to replace.
    gone = checkpointed(known.select("doc_id"))
    current = upserts.upsert_documents(known, documents).join(
        documents.select("doc_id"), "doc_id", "left_semi"
    )
    with catalog.change() as change:
        change.replace("chunks", found.chunks, touched, gone)
        change.replace("doc_metadata", found.metadata, touched, gone)
        vectors = catalog.table("chunk_embeddings").limit(0)
        change.replace("chunk_embeddings", vectors, touched, gone)
        # Everything that follows reads the chunks from storage, not from the files.
        stored = change.rows("chunks").drop("part")
        change.replace(
            "postings", lexical.build_postings(stored, stemmer), touched, gone, placed=True)
        catalog.refresh_statistics(change)
        if enrich:
            summaries, tagged = tags.enrich(stored, effort, summarise, tag)
            change.replace("tags", tagged, touched, gone)
            if settings.effort_profile(effort).enrich_summary and summarise:
                answered = summaries.filter(F.col("summary").isNotNull())
                current = upserts.update_summaries(current, answered)
        change.replace("documents", current, touched, gone)
    rejects = checkpointed(found.rejects)
    return IngestTotals(
        documents=documents.count(), chunks=stored.count(), failed=rejects.count(),
        rejects=rejects,
    )


def known_versions(catalog: Catalog, source: str) -> DataFrame:
    """Stored versions of a source."""
    return checkpointed(upserts.existing_versions(catalog.table("documents"), source))


def ingest_folder(
    catalog: Catalog, folder: str, full: bool = False, **options
) -> IngestTotals:
    """Ingest the new and changed files of a folder; all of them when `full`."""
    listing = list_folder(catalog.spark, folder)
    if full:
        return ingest(catalog, listing, folder_content(catalog.spark, folder), **options)
    changed = upserts.new_or_changed(listing, known_versions(catalog, "local"))
    changed = checkpointed(changed)
    content = folder_content(catalog.spark, folder, changed)
    return ingest(catalog, changed, content, **options)


def ingest_staged(
    catalog: Catalog, planned: DataFrame, folder: str, **options
) -> IngestTotals:
    """Ingest the staged files of a remote listing, downloaded to `folder`.

    `planned` comes from `plan_listing`; a file is found by its staged name.
    """
    staged = checkpointed(planned.filter(F.col("status") == "staged").select(
        "filename", "source_id", "source_uri", "source_modified", "mime_type", "doc_id",
        F.lit("gdrive").alias("source"),
    ))
    small = is_small(staged)

    def identified(files: DataFrame) -> DataFrame:
        local = files.drop(*[c for c in staged.columns if c != "filename"])
        return local.join(F.broadcast(staged) if small else staged, "filename")

    read = folder_content(catalog.spark, folder)
    listing = identified(list_folder(catalog.spark, folder))
    return ingest(catalog, listing, lambda exts: identified(read(exts)), **options)


def ingest_totals(documents: DataFrame, chunks: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row with the counts of a run."""
    return (
        documents.select(F.lit("documents").alias("what"))
        .unionByName(chunks.select(F.lit("chunks").alias("what")))
        .unionByName(rejects.select(F.lit("failed").alias("what")))
        .agg(*[
            F.count_if(F.col("what") == w).alias(w) for w in ("documents", "chunks", "failed")
        ])
    )
