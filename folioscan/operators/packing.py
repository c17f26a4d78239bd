"""Greedy packing of ordered rows into groups of bounded text.

Packing is sequential: where a group ends depends on where it began. To spread one
huge document over many tasks, its rows are cut into blocks, and each block is
reduced to a table "packing state on entry -> state on exit". Tables compose, so the
entry state of every block follows from small rows, after which all blocks are
packed at the same time. The result equals packing the document in one go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions.text import group_starts, let, pack_paragraphs
from folioscan.operators.running import ordered_join, running_before
from folioscan.sources.shared import checkpointed

BLOCK_ROWS = 1024
BLOCKS_PER_STRETCH = 1024


def _exit_states(lengths: np.ndarray, max_chars: int) -> np.ndarray:
    """Exit state for every entry state 0..max_chars+2, all moved together."""
    states = np.arange(max_chars + 3, dtype=np.int32)
    for length in lengths:
        if length > max_chars:
            states[:] = 0
        else:
            opens = (states == 0) | (states + length > max_chars)
            states = np.where(opens, 0, states) + np.int32(length + 2)
    return states


def _exit_tables(blocks: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """(keys, _block, _exit) from the item lengths of each block."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            exits = [_exit_states(np.asarray(row), max_chars) for row in pdf["_lengths"]]
            yield pdf.drop(columns="_lengths").assign(_exit=exits)

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "_block"]) + ", _exit array<int>"
    return blocks.select(*keys, "_block", "_lengths").mapInPandas(tables, schema)


def _walk(at: Column, tables: Column, entry: Column) -> Column:
    """(at, entry) of every table when they are passed in order from `entry`."""
    begin = F.struct(
        entry.cast("int").alias("state"), F.array().cast("array<int>").alias("seen")
    )
    end = F.aggregate(tables, begin, lambda acc, table: F.struct(
        F.get(table, acc["state"]).alias("state"),
        F.array_append(acc["seen"], acc["state"]).alias("seen"),
    ))
    return F.zip_with(at, end["seen"], lambda i, state: F.struct(
        i.alias("at"), state.alias("entry")
    ))


def _entry_states(tables: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """Entry state of every block of every key.

    Blocks are gathered in stretches of bounded size. A stretch composes to one
    table, the stretches of a key are walked from the empty state, and then every
    stretch walks its own blocks.
    """

    def ordered(index: str, table: str) -> list[Column]:
        pairs = F.array_sort(F.collect_list(F.struct(index, table)))
        return [
            F.transform(pairs, lambda p: p[index]).alias("_at"),
            F.transform(pairs, lambda p: p[table]).alias("_tables"),
        ]

    stretches = tables.groupBy(
        *keys, F.floor(F.col("_block") / BLOCKS_PER_STRETCH).alias("_stretch")
    ).agg(*ordered("_block", "_exit"))
    identity = F.sequence(F.lit(0), F.lit(max_chars + 2))
    composed = F.aggregate("_tables", identity, lambda states, table: F.transform(
        states, lambda state: F.get(table, state)
    ))
    stretch_entry = (
        stretches.select(*keys, "_stretch", composed.alias("_exit"))
        .groupBy(*keys).agg(*ordered("_stretch", "_exit"))
        .select(*keys, F.explode(_walk(F.col("_at"), F.col("_tables"), F.lit(0))).alias("w"))
        .select(*keys, F.col("w.at").alias("_stretch"), F.col("w.entry").alias("_enter"))
    )
    return (
        stretches.join(stretch_entry, [*keys, "_stretch"])
        .select(*keys, F.explode(
            _walk(F.col("_at"), F.col("_tables"), F.col("_enter"))
        ).alias("w"))
        .select(*keys, F.col("w.at").alias("_block"), F.col("w.entry").alias("_entry"))
    )


def _piece_count(item: Column, max_chars: int) -> Column:
    """Chunks an item makes when it is alone in its group."""
    return F.when(
        F.length(item["text"]) > max_chars, F.size(pack_paragraphs(item["text"], max_chars))
    ).otherwise(F.lit(1))


def pack_rows(
    rows: DataFrame,
    keys: list[str],
    position: str,
    items: str,
    max_chars: int = settings.CHUNK_CHARS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pack the text items of ordered rows into chunks joined by a blank line.

    `items` is an array of strings per row; `position` a non-negative whole number,
    unique within the keys. A null item, or a null array, is no item. An item longer than `max_chars` is packed by itself, by
    paragraph. Returns keys, `ordinal`, `first_at`, `last_at` (positions of the first
    and last row of the chunk's group) and `text`.
    """
    blocks = checkpointed(
        rows.select(*keys, F.col(position).alias("_at"), F.filter(
            F.coalesce(F.col(items), F.array().cast("array<string>")),
            lambda item: item.isNotNull(),
        ).alias("_items"))
        .withColumn("_block", F.floor(F.col("_at") / block_rows))
        .groupBy(*keys, "_block")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_items"))).alias("_rows"))
        .select(*keys, "_block", F.flatten(F.transform(
            "_rows", lambda r: F.transform(
                r["_items"], lambda t: F.struct(r["_at"].alias("at"), t.alias("text"))
            ),
        )).alias("_items"))
        .filter(F.size("_items") > 0)
    )
    lengths = F.transform("_items", lambda item: F.length(item["text"]))
    measured = blocks.select(*keys, "_block", lengths.alias("_lengths"))
    entries = _entry_states(_exit_tables(measured, keys, max_chars), keys, max_chars)
    starts = checkpointed(
        blocks.join(entries, [*keys, "_block"])
        .withColumn("_starts", group_starts(lengths, max_chars, F.col("_entry")))
        .select(*keys, "_block", "_starts", F.transform(
            "_starts", lambda i: _piece_count(F.get("_items", i), max_chars)
        ).alias("_pieces"))
    )
    total = F.aggregate("_pieces", F.lit(0), lambda s, n: s + n)
    for weight, name in ((F.size("_starts"), "_groups"), (total, "_ordinal")):
        starts = running_before(starts, keys, "_block", weight=weight, name=name)

    # A group that is open at a block's end goes on with the items before the next
    # block's first start; those parts meet again in the groupBy.
    carries = F.coalesce(F.get("_starts", F.lit(0)) != 0, F.lit(True))
    cuts = F.when(carries, F.concat(F.array(F.lit(0)), F.col("_starts"))).otherwise(
        F.col("_starts")
    )
    opened = blocks.join(
        starts.withColumn("_cuts", cuts).withColumn("_shift", carries.cast("int")),
        [*keys, "_block"],
    )

    def segment(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_cuts", k + 1), F.size("_items"))
        own = k - F.col("_shift")
        before = F.aggregate(
            F.slice("_pieces", 1, F.greatest(own, F.lit(0))), F.lit(0), lambda s, n: s + n
        )
        return let(F.slice("_items", begin + 1, end - begin), lambda part: F.struct(
            (F.col("_groups") + own).alias("group_no"),
            F.when(own >= 0, F.col("_ordinal") + before).alias("ordinal"),
            part[0]["at"].alias("first_at"),
            F.element_at(part, -1)["at"].alias("last_at"),
            F.size(part).alias("n_items"),
            F.array_join(F.transform(part, lambda item: item["text"]), "\n\n").alias("text"),
        ))

    groups = (
        opened.select(*keys, "_block", F.explode(F.transform("_cuts", segment)).alias("s"))
        .select(*keys, "_block", "s.*")
        .groupBy(*keys, "group_no")
        .agg(
            F.min("ordinal").alias("_first"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.sum("n_items").alias("_n"),
            ordered_join(F.col("text"), F.col("_block"), "\n\n").alias("text"),
        )
    )
    too_long = (F.col("_n") == 1) & (F.length("text") > max_chars)
    pieces = F.when(too_long, pack_paragraphs(F.col("text"), max_chars)).otherwise(
        F.array("text")
    )
    return groups.select(
        *keys, "first_at", "last_at", "_first", F.posexplode(pieces).alias("_k", "text")
    ).select(
        *keys, (F.col("_first") + F.col("_k")).alias("ordinal"), "first_at", "last_at", "text"
    )


def pack_array(items: Column, max_chars: int = settings.CHUNK_CHARS) -> Column:
    """The same packing for items that are one array: (first, last, pieces)."""

    def cut(values: Column, starts: Column) -> Column:
        def group(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(values))
            whole = F.array_join(F.slice(values, start + 1, end - start), "\n\n")
            long = (end - start == 1) & (F.length(F.get(values, start)) > max_chars)
            return F.struct(
                start.alias("first"),
                (end - 1).alias("last"),
                F.when(long, pack_paragraphs(F.get(values, start), max_chars))
                .otherwise(F.array(whole)).alias("pieces"),
            )

        return F.transform(starts, group)

    return let(items, lambda values: let(
        group_starts(F.transform(values, F.length), max_chars),
        lambda starts: cut(values, starts),
    ))
