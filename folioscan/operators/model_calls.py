"""Calling a model that the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscan import settings

# Called once per task with the model's name; returns a function from a list of
# inputs to a list of outputs, in the same order.
ModelFactory = Callable[[str], Callable[[list[Any]], list[Any]]]


def apply_model(
    df: DataFrame,
    in_col: str,
    out_col: str,
    out_type: str,
    factory: ModelFactory,
    model: str,
    batch_size: int = settings.EMBED_BATCH,
) -> DataFrame:
    """Add `out_col` and `error`, calling the model in batches inside the tasks.

    When a batch fails its rows are tried one by one, so a bad input costs only its
    own answer: it gets a null and the reason.
    """
    kept = [T.StructField(f.name, f.dataType) for f in df.schema]
    schema = T.StructType([
        *kept,
        T.StructField(out_col, T._parse_datatype_string(out_type)),
        T.StructField("error", T.StringType()),
    ])

    def call(function, inputs: list[Any]) -> tuple[list[Any], list[str | None]]:
        try:
            outputs = list(function(inputs))
            if len(outputs) != len(inputs):
                raise ValueError(f"{len(inputs)} inputs gave {len(outputs)} outputs")
            return outputs, [None] * len(inputs)
        except Exception as problem:
            if len(inputs) == 1:
                return [None], [f"{type(problem).__name__}: {problem}"]
            pairs = [call(function, [value]) for value in inputs]
            return [p[0][0] for p in pairs], [p[1][0] for p in pairs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = None
        for pdf in batches:
            if function is None and len(pdf):
                function = factory(model)
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                outputs, errors = call(function, part[in_col].tolist())
                part[out_col] = pd.Series(outputs, index=part.index, dtype=object)
                part["error"] = pd.Series(errors, index=part.index, dtype=object)
                yield part

    return df.mapInPandas(run, schema)
