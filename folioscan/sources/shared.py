"""Storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a temporary folder for a master of one machine, else an error:
    executors elsewhere could not read what the driver's machine holds.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.conf.get("spark.folioscan.scratch", None) is None:
        spark.conf.set("spark.folioscan.scratch", tempfile.mkdtemp(prefix="folioscan-"))
    return spark.conf.get("spark.folioscan.scratch")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, for plans that read it again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept_once(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there; for answers that cost money."""
    path = new_folder(df.sparkSession, "answers")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_reads(spark: SparkSession, size: int) -> Iterator[None]:
    """Tasks of a write inside read at most `size` bytes of files, or less if that is set."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    set_to = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(name, str(min(size, set_to)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(spark: SparkSession, pattern: str) -> None:
    """Delete the folders that a path pattern names and that no plan reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(path) or []:
        system.delete(status.getPath(), True)
