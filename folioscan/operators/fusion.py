"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan import settings


def pool_size(limit: int) -> int:
    """How deep each list is read before fusion."""
    return max(limit * 4, 20)


def with_rank(ranked: DataFrame) -> DataFrame:
    """0-based `rank` per query, by score; for lists that have none yet."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return ranked.withColumn("rank", F.row_number().over(order) - 1)


def union_of_lists(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Both ranked lists with the number of the list they come from."""
    columns = ["query_id", "chunk_id", "doc_id", "rank"]
    return lexical.select(*columns, F.lit(0).alias("list_no")).unionByName(
        dense.select(*columns, F.lit(1).alias("list_no"))
    )


def fuse(
    lexical: DataFrame, dense: DataFrame, limit: int, k: int = settings.RRF_K
) -> DataFrame:
    """Fused top `limit` per query with a 0-based `rank`.

    A chunk scores 1 / (k + rank) in every list that has it. Equal sums keep the
    order of first appearance: the lexical list, then what only the other has.
    """
    fused = union_of_lists(lexical, dense).groupBy("query_id", "chunk_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min("list_no").alias("_list"),
        F.min_by("rank", "list_no").alias("_rank"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "_list", "_rank", "chunk_id")
    return (
        fused.withColumn("_row", F.row_number().over(order))
        .filter(F.col("_row") <= limit)
        .select("query_id", "chunk_id", "doc_id", "score", (F.col("_row") - 1).alias("rank"))
    )
