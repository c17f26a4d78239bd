"""Where vectors live: an interface of five methods and the catalog's own store."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.keys import part_of
from folioscan.operators import dense
from folioscan.operators.filters import Filters, restrict
from folioscan.sources.catalog import Catalog
from folioscan.sources.shared import checkpointed

MODEL_SETTING = "embedding_model"
DIMENSION_SETTING = "embedding_dim"
MARK_SETTING = "embedded_version"

logger = logging.getLogger(__name__)


class VectorStore(ABC):
    """Storage and search of one vector per chunk."""

    @abstractmethod
    def locked_model(self) -> str | None:
        """Model of the stored vectors, None before the first."""

    @abstractmethod
    def ensure_model(self, requested: str) -> str:
        """Lock to a model on first use; afterwards the locked one is returned."""

    @abstractmethod
    def upsert(self, items: DataFrame) -> int:
        """Store (chunk_id, embedding); returns how many chunks got a vector."""

    @abstractmethod
    def missing_chunks(self, doc_id: str | None = None) -> DataFrame:
        """Chunks without a vector."""

    def missing_in_parts(
        self, first: int, last: int, parts: int, doc_id: str | None = None
    ) -> DataFrame:
        """Chunks without a vector in some parts of the catalog."""
        part = part_of(F.col("doc_id"), parts)
        return self.missing_chunks(doc_id).filter(part.between(first, last))

    def settle(self, version: int) -> None:
        """Told after a full backfill of a catalog version; a store may remember it."""

    @abstractmethod
    def search(self, queries: DataFrame, limit: int, filters: Filters = Filters()) -> DataFrame:
        """Top `limit` per query vector (query_id, embedding)."""


class ParquetVectorStore(VectorStore):
    """Exact cosine search over the catalog's table of vectors."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def locked_model(self) -> str | None:
        return self.catalog.setting(MODEL_SETTING)

    def ensure_model(self, requested: str) -> str:
        locked = self.catalog.lock(MODEL_SETTING, requested)
        if locked != requested:
            logger.warning("catalog is locked to %r; %r is ignored", locked, requested)
        return locked

    def upsert(self, items: DataFrame) -> int:
        rows = checkpointed(dense.store(self.catalog.table("chunks"), items))
        first = rows.select(F.size("embedding")).first()
        if first is None:
            return 0
        size = int(self.catalog.lock(DIMENSION_SETTING, str(first[0])))
        found = dense.dimension_check(rows, size).first()
        if found["n_wrong"]:
            raise ValueError(f"{found['n_wrong']} vectors do not have {size} dimensions")
        # Other vectors of the same documents move into the new batch with them.
        parts = [r[0] for r in rows.select(part_of(
            F.col("doc_id"), self.catalog.parts).alias("p")).distinct().collect()]
        old = self.catalog.stored("chunk_embeddings").filter(
            F.col("part").isin(*parts)).select(*rows.columns)
        kept = old.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").join(
            rows.select("chunk_id"), "chunk_id", "left_anti")
        self.catalog.replace("chunk_embeddings", kept.unionByName(rows), rows)
        return found["n_vectors"]

    def missing_chunks(self, doc_id: str | None = None) -> DataFrame:
        """Reads what came after the last complete backfill, and documents without vectors."""
        return dense.missing(
            self._candidates(), self.catalog.table("chunk_embeddings"), doc_id)

    def missing_in_parts(
        self, first: int, last: int, parts: int, doc_id: str | None = None
    ) -> DataFrame:
        """Only vectors of the same parts are compared; parts to come have none."""
        part = part_of(F.col("doc_id"), parts).between(first, last)
        known = self.catalog.stored("chunk_embeddings").filter(part)
        if parts == self.catalog.parts:
            known = known.filter(F.col("part").between(first, last))
        if not known.limit(1).count():
            known = known.limit(0)
        return dense.missing(self._candidates().filter(part), known, doc_id)

    def _candidates(self) -> DataFrame:
        mark = int(self.catalog.setting(MARK_SETTING) or 0)
        chunks = self.catalog.changes("chunks", mark)
        emptied = self.catalog.replaced("chunk_embeddings", mark) if mark else None
        if emptied is not None:
            again = self.catalog.table("chunks").join(
                emptied.select("doc_id"), "doc_id", "left_semi")
            chunks = chunks.unionByName(again).dropDuplicates(["chunk_id"])
        return chunks

    def settle(self, version: int) -> None:
        if not self.missing_chunks().limit(1).count():
            self.catalog.set_setting(MARK_SETTING, str(version))

    def search(self, queries: DataFrame, limit: int, filters: Filters = Filters()) -> DataFrame:
        vectors = restrict(
            self.catalog.table("chunk_embeddings"), self.catalog.table("documents"),
            self.catalog.table("tags"), filters,
        )
        return dense.search_batch(vectors, queries, limit)

    def count(self) -> int:
        return self.catalog.table("chunk_embeddings").count()


def vector_store(catalog: Catalog) -> VectorStore:
    """The store of a catalog: the one place another kind is put in."""
    return ParquetVectorStore(catalog)
