"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import ship_packages
from folioscan.sources.shared import new_folder

# Lower-cases A-Z only, whatever the locale; other letters stay as they are.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; makes sure that workers can import this package."""
    ship_packages(spark, "folioscan")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A text with A-Z, and no other letters, in lower case."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def stored(df: DataFrame, purpose: str, codec: str = "zstd") -> DataFrame:
    """`df` computed once, written to the shared folder and read again.

    Cuts the lineage, so later jobs neither repeat the work nor depend on executors.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.option("compression", codec).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """Like `stored`, with the rows of a key in one bucket, so joins on it leave them there."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    name = f"{purpose}-{path.rpartition('-')[2]}".replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(
        buckets, key).saveAsTable(name)
    release(spark)
    return spark.table(name)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one that no later plan reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs; it does so as plans are collected."""
    spark.sparkContext._jvm.System.gc()


def words(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8, A-Z lower-cased.

    `bytes.split` without arguments separates at exactly these six bytes.
    """
    return text.encode().translate(ASCII_LOWER).split()


def blocks(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int
) -> Iterator[pa.Table]:
    """Regroup a task's batches so that each holds about `max_bytes` of `column`.

    A larger batch is cut between rows; one row that is larger forms a block alone.
    """
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        index = batch.schema.get_field_index(column)
        start = size = 0
        for row, length in enumerate(_lengths(batch.column(index))):
            if size and held + size + length > max_bytes:
                waiting.append(batch.slice(start, row - start))
                yield pa.Table.from_batches(waiting)
                waiting, held, start, size = [], 0, row, 0
            elif held and held + size + length > max_bytes:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
            size += length
        if batch.num_rows > start:
            waiting.append(batch.slice(start))
            held += size
    if waiting:
        yield pa.Table.from_batches(waiting)


def _lengths(array: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
