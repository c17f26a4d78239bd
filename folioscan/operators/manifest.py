"""A readable index of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.filters import active

EMPTY_NOTE = "_No resources indexed yet. Ingest a folder first._"


def manifest_entries(documents: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per active document with its chunk count and joined tags."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    joined = tags.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags")
    )
    return (
        active(documents)
        .select("doc_id", "filename", "source_type", "title", "summary", "source_uri")
        .join(counts, "doc_id", "left")
        .join(joined, "doc_id", "left")
        .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    )


def entry_text() -> Column:
    """Markdown of one entry."""
    heading = F.coalesce(F.nullif("title", F.lit("")), "filename")
    return F.concat(
        F.lit("### "), heading, F.lit("\n- `"), F.col("filename"), F.lit("` · "),
        F.col("n_chunks").cast("string"), F.lit(" chunks"),
        F.when(F.col("tags") != "", F.concat(F.lit("\n- tags: "), "tags"))
        .otherwise(F.lit("")),
        F.when(F.col("source_uri") != "", F.concat(F.lit("\n- uri: "), "source_uri"))
        .otherwise(F.lit("")),
        F.when(F.col("summary") != "", F.concat(F.lit("\n\n"), "summary"))
        .otherwise(F.lit("")),
        F.lit("\n"),
    )


def manifest_blocks(entries: DataFrame) -> DataFrame:
    """(section, kind, filename, doc_id, block): section headings and entries.

    The first four columns are the order of the blocks in the file.
    """
    section = F.coalesce("source_type", F.lit("other")).alias("section")
    bodies = entries.select(
        section, F.lit(1).alias("kind"), "filename", "doc_id", entry_text().alias("block")
    )
    headings = entries.select(section).distinct().select(
        "section", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("doc_id"),
        F.concat(F.lit("## "), "section", F.lit("\n")).alias("block"),
    )
    return headings.unionByName(bodies)


def header_block(title: str, n_documents: int, stamp: str) -> str:
    """Opening lines of the manifest."""
    return (
        f"# {title}\n\n_Descriptive index of the catalog's resources._\n"
        f"_Updated {stamp} · {n_documents} documents._\n\n"
        "Browse this file first. To get the text of an entry, search the catalog.\n"
    )


def manifest_lines(
    entries: DataFrame, title: str, stamp: str
) -> DataFrame:
    """(block) in order: the whole manifest as a sorted table.

    The sort is a range shuffle: a large manifest is many tasks and many files,
    whose names keep the order.
    """
    spark = entries.sparkSession
    n = entries.count()
    opening = [("", -1, None, None, header_block(title, n, stamp))]
    if n == 0:
        opening.append(("", 0, None, None, EMPTY_NOTE))
    blocks = manifest_blocks(entries)
    first = spark.createDataFrame(opening, blocks.schema)
    return (
        first.unionByName(blocks)
        .orderBy("section", "kind", F.col("filename").asc_nulls_first(), "doc_id")
        .select("block")
    )


def write_manifest(
    entries: DataFrame, path: str, title: str, stamp: str
) -> None:
    """Write the manifest as text files that read in name order."""
    manifest_lines(entries, title, stamp).write.mode("overwrite").text(path)
