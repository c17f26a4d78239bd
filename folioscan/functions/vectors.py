"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions.terms import hash_tokens, term_counts
from folioscan.functions.text import let


def as_double(vector: Column) -> Column:
    """Widen before arithmetic: single-precision dot products lose the tie order."""
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hashing_embedding(text: Column, dimensions: int = settings.HASH_DIMENSIONS) -> Column:
    """Deterministic bag-of-words vector: one bucket per token, unit length.

    The bucket is the first 32 bits of the token's sha1. Text without a token has
    the zero vector.
    """

    def bucket(token: Column) -> Column:
        return (
            F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % dimensions
        ).cast("int")

    def dense(counts: Column) -> Column:
        by_bucket = F.map_from_entries(counts)

        def scale(table: Column) -> Column:
            length = F.sqrt(F.aggregate(
                F.map_values(table), F.lit(0.0), lambda s, n: s + n.cast("double") * n
            ))
            return let(length, lambda size: F.transform(
                F.sequence(F.lit(0), F.lit(dimensions - 1)),
                lambda b: F.when(size > 0, F.coalesce(F.try_element_at(table, b), F.lit(0)) / size)
                .otherwise(F.lit(0.0)),
            ))

        return let(by_bucket, scale)

    return let(term_counts(F.transform(hash_tokens(text), bucket)), dense)
