"""Large delimited files, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.running import running_before

# Lines of one split are numbered together; 2^33 is the span of the row counter.
_SPLIT_SPAN = 1 << 33


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8"
) -> tuple[DataFrame, str]:
    """(local_path, row_no, cells) of all files below `path`, and their header text.

    Every value is a string and an empty field stays empty. The files share one
    header and hold one record per line. Rows are numbered by split, so one huge
    file is read and numbered by many tasks.
    """
    raw = (
        spark.read.option("header", "true").option("sep", delimiter)
        .option("encoding", encoding).option("inferSchema", "false")
        .option("enforceSchema", "true").option("emptyValue", "").option("nullValue", "\x00")
        .option("recursiveFileLookup", "true").csv(path)
    )
    columns = raw.columns
    placed = raw.select(
        F.col("_metadata.file_path").alias("local_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.array(*[F.coalesce(f"`{c}`", F.lit("")) for c in columns]).alias("cells"),
        F.pmod(F.monotonically_increasing_id(), F.lit(_SPLIT_SPAN)).alias("_line"),
    )
    # Inside a split the counter rises with the line; splits are ordered by offset.
    numbered = running_before(
        placed, ["local_path", "_start"], "_line", name="_in_split"
    )
    splits = numbered.groupBy("local_path", "_start").agg(F.count("*").alias("_rows"))
    offsets = running_before(
        splits, ["local_path"], "_start", weight=F.col("_rows"), name="_before",
        width=1 << 40,
    ).select("local_path", "_start", "_before")
    rows = numbered.join(offsets, ["local_path", "_start"]).select(
        "local_path", (F.col("_before") + F.col("_in_split")).alias("row_no"), "cells"
    )
    return rows, ",".join(columns)
