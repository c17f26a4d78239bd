"""Numbering and running totals that split a hot key over many tasks.

A window over one key runs in one task, however large the key. Here rows are
windowed inside fixed ranges of their position, and only one total per range is
windowed over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE_WIDTH = 1 << 16


def running_before(
    df: DataFrame,
    keys: list[str],
    position: str,
    weight: Column | None = None,
    name: str = "before",
    first_of: str | None = None,
    total: str | None = None,
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Add the sum of `weight` (default 1) over the earlier rows of the same key.

    `position` is a non-negative whole number, unique within the key; gaps are
    allowed. `first_of` adds `first_<column>`, the value in the first row of the
    key; `total` names a column for the sum over the whole key.
    """
    weight = F.lit(1) if weight is None else weight
    ranged = df.withColumn("_w", weight.cast("bigint")).withColumn(
        "_range", F.floor(F.col(position) / width)
    )
    per_range = [F.sum("_w").alias("_n")]
    if first_of:
        per_range.append(F.min_by(first_of, position).alias("_first"))
    ranges = ranged.groupBy(*keys, "_range").agg(*per_range)

    whole = W.partitionBy(*keys).orderBy("_range")
    offsets = [
        F.coalesce(F.sum("_n").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        .alias("_offset")
    ]
    if first_of:
        offsets.append(F.first("_first").over(whole).alias(f"first_{first_of}"))
    if total:
        offsets.append(
            F.sum("_n").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            .alias(total)
        )
    offsets = ranges.select(*keys, "_range", *offsets)

    inside = (
        W.partitionBy(*keys, "_range").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_w", "_range", "_inside", "_offset")
    )


def ordered_join(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: values joined in the given order. For groups of bounded size."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("at"), value.alias("value"))))
    return F.array_join(F.transform(pairs, lambda pair: pair["value"]), separator)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle an input that has fewer partitions than the cluster has cores.

    A small file is one row group and so one task; operators that spend their time
    on CPU gain from a shuffle of it. Inputs with enough partitions pass through.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
