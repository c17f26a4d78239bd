"""Catalog relations that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import keys
from folioscan.functions import text as tx
from folioscan.functions import vectors as vx
from folioscan.operators import chunking
from folioscan.operators.running import spread

TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; text tables are spread when their file is one row group."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog documents, still with their text, from the `documents` table."""
    ext = (
        F.when(F.substring("source", 4, 9).cast("int") % 4 == 0, ".txt")
        .when(F.substring("source", 4, 9).cast("int") % 4 == 1, ".md")
        .when(F.substring("source", 4, 9).cast("int") % 4 == 2, ".html")
        .otherwise(".json")
    )
    number, version = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    filename = F.concat("source", F.lit("-"), number, ext)
    return table(spark, sf_dir, "documents").select(
        keys.document_id(number, version).alias("doc_id"),
        F.col("doc_id").alias("number"),
        filename.alias("filename"),
        ext.alias("ext"),
        tx.source_type(ext).alias("source_type"),
        F.when(F.col("lang") == "en", "local").otherwise("gdrive").alias("source"),
        number.alias("source_id"),
        F.concat(F.lit("file:///"), filename).alias("source_uri"),
        version.alias("source_modified"),
        F.lit(None).cast("string").alias("summary"),
        F.nullif(tx.strip(F.split("text", "\n")[0]), F.lit("")).alias("title"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_chunks(documents(spark, sf_dir))


def label_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tag) from `labels`."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("number"),
        F.explode(F.array(
            F.concat(F.lit("quality-"), F.col("quality").cast("string")),
            F.concat(F.lit("toxic-"), F.col("toxic").cast("string")),
        )).alias("tag"),
    )
    return documents(spark, sf_dir).select("doc_id", "number").join(labels, "number").select(
        "doc_id", "tag"
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query table from `benchmark`."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embedded(rows: DataFrame, *keep: str) -> DataFrame:
    """Hashing vectors of a text column, in the stored single precision."""
    return rows.select(
        *keep, vx.hashing_embedding(F.col("text")).cast("array<float>").alias("embedding")
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(chunks(spark, sf_dir), "chunk_id", "doc_id")


def plain_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `embeddings` table in the shape of stored chunk vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("v-%05d", "vec_id").alias("chunk_id"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("doc_id"),
        "embedding",
    )
