"""JSON values as searchable `path: value` lines.

Key order and number text follow the source, which the JVM parsers do not keep,
so the leaves are read by the Python parser in Arrow batches.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_text(value: Any) -> str:
    """All leaves of a parsed value, one `path: value` line each, in source order.

    Walks with a stack of its own, so nesting is bounded by memory only.
    """
    lines: list[str] = []
    waiting = [("", value)]
    while waiting:
        path, item = waiting.pop()
        match item:
            case dict():
                dot = "." if path else ""
                inside = [(f"{path}{dot}{name}", part) for name, part in item.items()]
            case list():
                inside = [(f"{path}[{number}]", part) for number, part in enumerate(item)]
            case _:
                leaf = "" if item is None else str(item)
                lines.append(f"{path}: {leaf}" if path else leaf)
                continue
        waiting.extend(inside[::-1])
    return "\n".join(lines)


def _parsed(raw: str) -> Any:
    """A JSON value; nesting that the parser cannot follow is a ValueError too."""
    try:
        return json.loads(raw)
    except RecursionError:
        raise ValueError("JSON is nested too deeply") from None


def file_records(raw: str, ext: str) -> list[Any]:
    """The records of a file: of JSON Lines its lines, of JSON its items or the one value.

    A .json file that is no JSON as a whole is read as lines. Raises ValueError when a
    record does not parse.
    """
    if ext != ".jsonl" and raw.strip():
        try:
            value = _parsed(raw)
        except json.JSONDecodeError:
            pass
        else:
            return value if isinstance(value, list) else [value]
    filled = filter(str.strip, raw.splitlines())
    return list(map(_parsed, filled))


@F.pandas_udf(T.StringType())
def flatten_json(text: pd.Series) -> pd.Series:
    """`path: value` lines of one JSON value per row; null when it does not parse."""

    def one(raw: str | None) -> str | None:
        try:
            return None if raw is None else flat_text(_parsed(raw))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.StructType([
    T.StructField("records", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
]))
def json_records(text: pd.Series, ext: pd.Series) -> pd.DataFrame:
    """Flattened records of a whole file per row, or the reason it failed."""
    rows = []
    for raw, suffix in zip(text, ext):
        try:
            rows.append(([flat_text(r) for r in file_records(raw or "", suffix)], None))
        except ValueError as problem:
            rows.append((None, str(problem)))
    return pd.DataFrame(rows, columns=["records", "error"])
