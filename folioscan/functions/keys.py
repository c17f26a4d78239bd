"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(identity: Column, version: Column) -> Column:
    """16 hex digits that change with either the identity or the version."""
    return F.substring(F.sha1(F.concat(identity, F.lit("|"), version)), 1, 16)


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    """Document id and five-digit ordinal."""
    return F.format_string("%s-%05d", doc_id, ordinal)


def part_of(doc_id: Column, parts: int) -> Column:
    """The catalog partition a document belongs to."""
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")
