"""Backfill: vectors for the chunks that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions import vectors as vx
from folioscan.operators.model_calls import ModelFactory, apply_model
from folioscan.sources.catalog import Catalog
from folioscan.sources.vector_store import vector_store

# The built-in embedder; any other name needs a factory.
HASHING_MODEL = f"hashing-{settings.HASH_DIMENSIONS}"


def embed(
    rows: DataFrame, model: str, factory: ModelFactory | None = None, text: str = "text"
) -> DataFrame:
    """Add `embedding` to rows with a text; rows whose call failed are left out."""
    if model == HASHING_MODEL:
        vector = vx.hashing_embedding(F.col(text)).cast("array<float>")
        return rows.withColumn("embedding", vector)
    if factory is None:
        raise RuntimeError(f"embedding model {model!r} needs a factory")
    answered = apply_model(rows, text, "embedding", "array<float>", factory, model)
    return answered.filter(F.col("error").isNull()).drop("error")


def backfill(
    catalog: Catalog,
    model: str = HASHING_MODEL,
    factory: ModelFactory | None = None,
    doc_id: str | None = None,
    parts_per_commit: int | None = None,
) -> int:
    """Embed the missing chunks and return how many got a vector.

    Each commit covers `parts_per_commit` parts of the catalog (default all), so a
    run that dies keeps what it committed and the next one continues from there.
    """
    store = vector_store(catalog)
    model = store.ensure_model(model)
    step = parts_per_commit or catalog.parts
    written, version = 0, catalog.last_batch()
    for start in range(0, catalog.parts, step):
        pending = store.missing_in_parts(start, start + step - 1, catalog.parts, doc_id)
        vectors = embed(pending.select("chunk_id", "text"), model, factory)
        written += store.upsert(vectors.select("chunk_id", "embedding"))
    if doc_id is None:
        store.settle(version)
    return written
