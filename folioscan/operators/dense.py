"""Vectors of chunks: storing, checking and exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions import vectors as vx
from folioscan.operators.ranking import BestOfBlocks, in_order, stable_score, top_k

# Query vectors in one block of the grid.
QUERIES_PER_BLOCK = 1024
ROWS_PER_PRODUCT = 1024
QUERIES_PER_PRODUCT = 256
# Copies of query vectors that are sent, where fewer parts of the vectors allow it.
QUERIES_SENT = 1 << 20
VECTORS_PER_PART = 1 << 16
QUERIES_PER_PART = 1 << 15


def store(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Vectors (chunk_id, embedding) of known chunks, completed with doc_id."""
    return items.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select(
        "chunk_id", "doc_id", F.col("embedding").cast("array<float>").alias("embedding")
    )


def unknown_chunks(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Vectors offered for chunks that do not exist."""
    return items.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def missing(chunks: DataFrame, embeddings: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Chunks without a vector: the work list of a backfill."""
    wanted = chunks if doc_id is None else chunks.filter(F.col("doc_id") == doc_id)
    return wanted.join(embeddings.select("chunk_id"), "chunk_id", "left_anti").select(
        "chunk_id", "doc_id", "ordinal", "text"
    )


def dimension_check(embeddings: DataFrame, dimensions: int) -> DataFrame:
    """One row: how many vectors there are and how many have another length."""
    return embeddings.agg(
        F.count("*").alias("n_vectors"),
        F.count_if(F.size("embedding") != dimensions).alias("n_wrong"),
    )


def score_one(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """Cosine of every vector with one query vector; zero vectors have no score."""
    constant = F.lit([float(v) for v in query])
    similarity = vx.cosine(vx.as_double(F.col("embedding")), constant)
    return embeddings.select(
        "chunk_id", "doc_id", stable_score(similarity).alias("score")
    ).filter(F.col("score").isNotNull())


def _blocks(rows: DataFrame, columns: list[str], size: int, prefix: str) -> DataFrame:
    """Rows with an `embedding` packed into blocks of one width, `size` rows at most.

    Zero vectors have no direction and are left out; the others get unit length.
    """
    names = [f"{prefix}_{c}" for c in columns]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths = batch["embedding"].map(len)
            for width, group in batch.groupby(widths):
                for start in range(0, len(group), size):
                    part = group.iloc[start:start + size]
                    matrix = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                    length = np.linalg.norm(matrix, axis=1)
                    some = length > 0
                    unit = matrix[some] / length[some, None]
                    yield pd.DataFrame({
                        "width": [width], f"{prefix}_cells": [unit.tobytes()],
                        **{n: [part[c].to_numpy(dtype=object)[some].tolist()]
                           for c, n in zip(columns, names)},
                    })

    schema = f"width int, {prefix}_cells binary, " + ", ".join(
        f"{n} array<{kinds[c]}>" for c, n in zip(columns, names))
    return rows.select(*columns, "embedding").filter(
        F.col("embedding").isNotNull()).mapInPandas(run, schema)


def _grid(embeddings: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """Parts of the vectors and of the queries: every vector part meets every query part.

    A part of either side is sent once for each part of the other. Few queries go to every
    part; many meet fewer and larger parts of the vectors, and are cut themselves.
    """
    parts = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.count()
    if asked * parts <= QUERIES_SENT:
        return parts, 1
    large = -(-embeddings.count() // VECTORS_PER_PART)
    across = max(large, min(parts, QUERIES_SENT // asked), 1)
    return across, max(1, -(-parts // across), -(-asked // QUERIES_PER_PART))


def search_batch(
    embeddings: DataFrame, queries: DataFrame, k: int, per_block: int = QUERIES_PER_BLOCK
) -> DataFrame:
    """Exact top-k cosine for a table of query vectors (query_id, embedding).

    Blocks of queries meet blocks of vectors in a grid of cells that a shuffle spreads over
    the tasks; the driver sees neither side and neither is broadcast. A task multiplies block
    by block and keeps the `k` best vectors of each query of its cells, so pairs never reach
    a shuffle. Rows that share a query_id are answered together.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    across, down = _grid(embeddings, queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vectors = _blocks(embeddings, ["chunk_id", "doc_id"], ROWS_PER_PRODUCT, "v").withColumn(
        "part", F.pmod(F.xxhash64("v_cells", "v_chunk_id"), F.lit(across)).cast("int")
    ).withColumn("ask", every(down))
    asked = _blocks(
        queries.select("query_id", vx.as_double(F.col("embedding")).alias("embedding")),
        ["query_id"], per_block, "q",
    ).withColumn("block", F.monotonically_increasing_id()).withColumn(
        "ask", F.pmod(F.xxhash64("block"), F.lit(down)).cast("int")).withColumn("part", every(across))
    schema = f"query_id {kind}, chunk_id string, doc_id string, score double"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cell, now, vectors, width = {}, None, None, None, None
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for n in range(batch.num_rows):
                at = tuple(columns[c][n].as_py() for c in ("part", "ask", "width"))
                if at != cell:
                    yield from (answer(*b) for b in best.values())
                    best, cell, now, width = {}, at, None, at[2]
                raw = columns["v_cells"][n].as_buffer()
                if now is None or not now.equals(raw):
                    now = raw
                    ids, docs = (np.array(columns[c][n].as_py(), dtype=object)
                                 for c in ("v_chunk_id", "v_doc_id"))
                    order = np.argsort(in_order(ids), kind="stable")
                    vectors = (np.frombuffer(raw).reshape(-1, width)[order],
                               ids[order], docs[order])
                block = columns["block"][n].as_py()
                if block not in best:
                    query = np.frombuffer(columns["q_cells"][n].as_buffer()).reshape(-1, width)
                    best[block] = (columns["q_query_id"][n].values, query.copy(),
                                   BestOfBlocks(len(query), k))
                _, query, leaders = best[block]
                for low in range(0, len(query), QUERIES_PER_PRODUCT):
                    leaders.add(query[low:low + QUERIES_PER_PRODUCT] @ vectors[0].T,
                                *vectors[1:], low)
        yield from (answer(*b) for b in best.values())

    def answer(queries: pa.Array, _: np.ndarray, found: BestOfBlocks) -> pa.RecordBatch:
        found.settle()
        return pa.RecordBatch.from_arrays([
            queries.take(pa.array(found.rows)), pa.array(found.ids, pa.string()),
            pa.array(found.docs, pa.string()), pa.array(found.scores, pa.float64()),
        ], names=["query_id", "chunk_id", "doc_id", "score"])

    # Sorted by cell on both sides: a cell's queries are held, its vectors pass by.
    found = vectors.hint("merge").join(asked, ["part", "ask", "width"]).mapInArrow(
        products, schema)
    return top_k(found, k)
