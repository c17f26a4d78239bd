"""Metadata restrictions shared by every retriever."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Restrictions on the documents a search may return; empty means none."""

    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    source: str | None = None

    @classmethod
    def of(cls, types=None, tags=None, source=None) -> Filters:
        return cls(tuple(types or ()), tuple(tags or ()), source or None)

    def __bool__(self) -> bool:
        return bool(self.types or self.tags or self.source)


def matching_documents(documents: DataFrame, tags: DataFrame, wanted: Filters) -> DataFrame:
    """Documents that pass all restrictions; a document counts once per match."""
    found = documents
    if wanted.types:
        found = found.filter(F.col("source_type").isin(*wanted.types))
    if wanted.source:
        found = found.filter(F.col("source") == wanted.source)
    if wanted.tags:
        tagged = tags.filter(F.col("tag").isin(*wanted.tags)).select("doc_id")
        found = found.join(tagged, "doc_id", "left_semi")
    return found


def restrict(
    rows: DataFrame, documents: DataFrame, tags: DataFrame, wanted: Filters
) -> DataFrame:
    """Rows (with a doc_id) of matching documents; unchanged without restrictions."""
    if not wanted:
        return rows
    allowed = matching_documents(documents, tags, wanted).select("doc_id")
    return rows.join(allowed, "doc_id", "left_semi")


def active(documents: DataFrame) -> DataFrame:
    """Documents that are not archived."""
    return documents.filter(F.col("status") == "active")
