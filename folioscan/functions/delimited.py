"""Decoding and delimiter choice of delimited text."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions import text as tx

# Rows of cells that a task holds at a time.
ROWS_AT_ONCE = 2000
# A line with its end, as text files without newline translation give it.
_LINE = re.compile(r"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+")
# Where the Windows code page differs from Latin-1: the control range.
_CONTROLS = bytes(range(0x80, 0xA0))
_WINDOWS = _CONTROLS.decode("cp1252", errors="replace")


def utf8_text(content: Column) -> Column:
    """UTF-8 text of bytes; what is not valid becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def decoded(content: Column) -> Column:
    """Text of bytes that are UTF-8 or else Windows-1252, judged on all bytes."""
    latin = F.translate(
        F.decode(content, "ISO-8859-1"), _CONTROLS.decode("latin-1"), _WINDOWS
    )
    unmarked = F.regexp_replace(utf8_text(content), "^\\x{feff}", "")
    return F.when(F.is_valid_utf8(content.cast("string")), unmarked).otherwise(latin)


def sniff_delimiter(text: Column) -> Column:
    """The candidate whose count in the first line most other lines repeat.

    Quoted parts do not count. Comma when no candidate occurs in the first line;
    among equals the first in the list of candidates.
    """
    bare = F.regexp_replace(text, '"[^"]*"', "")
    rows = F.filter(tx.lines(bare), lambda line: tx.strip(line) != "")

    def share(values: Column, delimiter: str) -> Column:
        def count(line: Column) -> Column:
            return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))

        first = count(F.coalesce(F.get(values, F.lit(0)), F.lit("")))
        same = F.size(F.filter(values, lambda line: count(line) == first))
        return F.when(first > 0, same).otherwise(F.lit(0))

    def choose(values: Column) -> Column:
        shares = [share(values, d) for d in settings.DELIMITERS]
        return tx.let(F.array(*shares), lambda s: F.when(
            F.array_max(s) > 0,
            F.element_at(
                F.array(*[F.lit(d) for d in settings.DELIMITERS]),
                F.array_position(s, F.array_max(s)).cast("int"),
            ),
        ).otherwise(F.lit(",")))

    return tx.let(rows, choose)


def _records(text: str | None, mark: str) -> Iterator[list[str]]:
    """Rows of cells, one at a time; lines without a cell are dropped.

    Quotes are respected and all values are strings. Fields may have any length.
    """
    csv.field_size_limit(sys.maxsize)
    lines = (found.group() for found in _LINE.finditer(text or ""))
    return (row for row in csv.reader(lines, delimiter=mark) if row)


def _counted(text: str | None, mark: str) -> tuple[int, str | None]:
    """How many rows a text has; 0 and the reason when it cannot be read."""
    try:
        return sum(1 for _ in _records(text, mark)), None
    except csv.Error as problem:
        return 0, str(problem)


def count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: (doc_id, local_path, text, delimiter) to the count of rows or an error."""
    for pdf in batches:
        found = [_counted(t, m) for t, m in zip(pdf["text"], pdf["delimiter"])]
        yield pdf[["doc_id", "local_path"]].assign(
            rows=[n for n, _ in found], error=[error for _, error in found])


def parse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: (doc_id, text, delimiter) to (doc_id, header, row_no, cells).

    A row each below the header, so no file is ever put together as one value. A file that
    cannot be read to its end has none.
    """
    for pdf in batches:
        for doc, text, mark in zip(pdf["doc_id"], pdf["text"], pdf["delimiter"]):
            if _counted(text, mark)[1] is not None:
                continue
            rows = _records(text, mark)
            header, at = next(rows, None), 0
            while cells := list(islice(rows, ROWS_AT_ONCE)):
                yield pd.DataFrame({
                    "doc_id": [doc] * len(cells), "header": [header] * len(cells),
                    "row_no": range(at, at + len(cells)), "cells": cells})
                at += len(cells)
