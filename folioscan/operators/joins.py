"""Joins whose strategy follows from a checked size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32 << 20
SALTS = 32
# Keys whose digests a task holds: 24 bytes each.
HELD_KEYS = 1 << 22


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `max_rows` rows; a partial aggregate, no row is moved.

    Text columns count too: their total length must stay below BROADCAST_CHARS.
    """
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    chars = sum((F.coalesce(F.length(c), F.lit(0)).cast("bigint") for c in texts), F.lit(0))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    return rows <= max_rows and size <= BROADCAST_CHARS


def join_small(
    big: DataFrame, other: DataFrame, keys: list[str], spread_by: Column, small: bool,
    how: str = "inner",
) -> DataFrame:
    """Join a big side that may hold hot keys with a usually small side.

    `small` is the outcome of `is_small` on the other side or on what it was cut
    from: then it is broadcast. Otherwise both sides are shuffled on the keys and a
    salt taken from `spread_by`, so that the rows of a hot key go to many tasks; the
    other side is repeated once per salt.
    """
    if small:
        return big.join(F.broadcast(other), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    repeated = other.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def held_numbers(keys: DataFrame, key: str, number: Column) -> Callable[[bool], Column] | None:
    """Gives a column: the largest `number` of a row's `key` among the keys, -1 without it.

    Rows stay where they are, since the keys come to them, as digests of 128 bits. For at
    most HELD_KEYS rows of keys; numbers are not negative. None where two keys share the
    first half of a digest: they have to be joined. A column made with `last` is computed
    after the joins below it.
    """
    digest = [F.xxhash64(key), F.xxhash64(F.lit("second half"), key)]
    found = keys.filter(F.col(key).isNotNull()).select(
        *(d.alias(n) for d, n in zip(digest, "ab", strict=True)),
        number.cast("bigint").alias("n")).toArrow()
    a, b, n = (found.column(c).to_numpy() for c in "abn")
    order = np.lexsort((n, b, a))
    a, b, n = a[order], b[order], n[order]
    last = np.r_[(a[1:] != a[:-1]) | (b[1:] != b[:-1]), np.ones(min(1, len(a)), bool)]
    a, b, n = a[last], b[last], n[last]
    if (a[1:] == a[:-1]).any():
        return None
    known = keys.sparkSession.sparkContext.broadcast((a, b, n))

    @F.pandas_udf("bigint")
    def lookup(first: pd.Series, second: pd.Series) -> pd.Series:
        a, b, n = known.value
        if not len(a):
            return pd.Series(np.full(len(first), -1))
        at = np.minimum(np.searchsorted(a, first.to_numpy()), len(a) - 1)
        same = (a[at] == first.to_numpy()) & (b[at] == second.to_numpy())
        return pd.Series(np.where(same, n[at], -1))

    # What is not deterministic is not moved below a join.
    pinned = F.pandas_udf(lookup.func, "bigint").asNondeterministic()
    return lambda last=False: F.when(
        F.col(key).isNotNull(), (pinned if last else lookup)(*digest)).otherwise(-1)


def with_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose `key` is among the keys; up to HELD_KEYS of these no row is moved."""
    keys = keys.select(key)
    if is_small(keys):
        return rows.join(F.broadcast(keys), key, "left_semi")
    few = keys.limit(HELD_KEYS + 1).count() <= HELD_KEYS
    number = held_numbers(keys, key, F.lit(0)) if few else None
    if number is None:
        return rows.join(keys, key, "left_semi")
    return rows.filter(number() >= 0)
