"""Incremental runs as Structured Streaming queries.

Both process what has arrived and stop; the checkpoint remembers what was seen, and
every batch is idempotent, so a batch that is repeated after a failure does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan import schemas
from folioscan.operators import dense, upserts
from folioscan.operators.model_calls import ModelFactory
from folioscan.plans.backfill import HASHING_MODEL, embed
from folioscan.plans.ingest import ingest, known_versions
from folioscan.sources.catalog import Catalog
from folioscan.sources.files import folder_content, list_folder
from folioscan.sources.shared import checkpointed
from folioscan.sources.vector_store import vector_store


def ingest_stream(
    catalog: Catalog, folder: str, checkpoint: str, files_per_batch: int = 10_000, **options
) -> StreamingQuery:
    """Ingest files as they appear or change below `folder`.

    What a file source has seen it does not give again, so the stream reads listings: each
    start adds one, beside the checkpoint, of the files whose version the catalog lacks. A
    rewritten file takes the place of its older version; files older than all changed ones
    are not opened.
    """
    spark = catalog.spark
    listings = checkpoint.rstrip("/") + "-listings"
    listing = upserts.new_or_changed(list_folder(spark, folder), known_versions(catalog, "local"))
    listing.write.option("maxRecordsPerFile", files_per_batch).mode("append").parquet(listings)
    arrived = spark.readStream.schema(listing.schema).option(
        "maxFilesPerTrigger", 1).parquet(listings)

    def run(batch: DataFrame, _: int) -> None:
        # A batch before this one, or a batch run, may have taken a file meanwhile.
        changed = checkpointed(
            upserts.new_or_changed(batch, known_versions(catalog, "local")).distinct())
        if changed.isEmpty():
            return
        ingest(catalog, changed, folder_content(spark, folder, changed), **options)

    return (
        arrived.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(run).start()
    )


def backfill_stream(
    catalog: Catalog,
    checkpoint: str,
    model: str = HASHING_MODEL,
    factory: ModelFactory | None = None,
) -> StreamingQuery:
    """Embed chunks as they are written to the catalog."""
    store = vector_store(catalog)
    model = store.ensure_model(model)
    chunks = catalog.spark.readStream.schema(schemas.CHUNKS).option(
        "recursiveFileLookup", "true"
    ).parquet(catalog.path("chunks"))

    def run(batch: DataFrame, _: int) -> None:
        arrived = batch.filter(F.col("chunk_id").isNotNull())
        pending = dense.missing(arrived, catalog.table("chunk_embeddings"))
        vectors = embed(pending.select("chunk_id", "text"), model, factory)
        store.upsert(vectors.select("chunk_id", "embedding"))

    return (
        chunks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(run).start()
    )
