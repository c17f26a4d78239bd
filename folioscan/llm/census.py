"""How often hashed entries occur over all blocks of a corpus, in shards of the hash range.

A block sends each distinct entry once, so an entry that a third of all documents hold is a
row per block and not a row per document. Entries travel packed, a binary row per block and
shard; each shard sorts what it gets and answers with one byte per entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import stored


class Block:
    """One row of the encoded blocks."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self._row = {n: batch.column(i)[at] for i, n in enumerate(batch.schema.names)}
        self.number = self._row["block"].as_py()

    def array(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self._row[name].as_buffer(), kind).astype(
            np.int64 if kind is np.int32 else kind)

    def data(self) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._row["data"].as_py())

    def list(self, name: str):
        """A list column; missing where the block has no such rows."""
        return self._row[name].as_py() or ()

    def values(self, name: str) -> pa.Array:
        return self._row[name].values


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield Block(batch, at)


def _distinct(low: np.ndarray, high: np.ndarray | None, shards: int):
    """Distinct entries in shard order, each entry's number among them, counts, shard begins.

    Without `high`, entries are told apart by 32 bits and their shard only: counts may then
    be too high, never too low.
    """
    shard = (low >> np.uint64(32)) % np.uint64(shards)
    near = shard << np.uint64(32) | low & np.uint64(0xFFFFFFFF)
    if high is None:
        order = np.argsort(near)
        first = near[order]
        new = np.ones(len(order), bool)
        new[1:] = first[1:] != first[:-1]
        first = first[new]
        which = near.view(np.int64)  # the entries are done with; their place takes the numbers
        which[order] = np.cumsum(new) - 1
        del order
        count = np.diff(np.append(np.flatnonzero(new), len(new)))
        parts = {"near": first.astype(np.uint32)}
    else:
        order = np.lexsort((high, low, shard))
        a, b = low[order], high[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = near[order][new]
        count = np.diff(np.append(np.flatnonzero(new), len(order)))
        parts = {"near": a[new], "far": b[new]}
    begins = np.searchsorted(first >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
    return parts, which, np.minimum(count, 255).astype(np.uint8), begins


def census(
    encoded: DataFrame, entries: Callable, shards: int
) -> DataFrame:
    """block and classes: what the census knows about each distinct entry of the block.

    `entries` makes a block's entries of its row: an array of 64-bit hashes, whose class is
    then 0 if nothing else in the corpus has it, else 1 + log2 of the count; or two arrays,
    128 bits that are compared in full, whose class is 0, or 1 in the first of several
    blocks that have it, or 2 in a later one. `levels` reads the answer.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in block_rows(batches):
            found = entries(block)
            low, high = found if isinstance(found, tuple) else (found, None)
            parts, _, count, begins = _distinct(low, high, shards)
            names = [s for s in range(shards) if begins[s] < begins[s + 1]]

            def cut(array: np.ndarray, names=names, begins=begins) -> pa.Array:
                return pa.array([array[begins[s]:begins[s + 1]].tobytes() for s in names],
                                pa.binary())

            far = cut(parts["far"]) if "far" in parts else pa.nulls(len(names), pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int32()), pa.array([block.number] * len(names), pa.int64()),
                cut(parts["near"]), far, cut(count),
            ], names=["shard", "block", "near", "far", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        exact = table.column("far").null_count == 0

        def read(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]

        near = read("near", np.uint64 if exact else np.uint32)
        sizes = np.array([len(x) for x in near])
        low, count = np.concatenate(near), np.concatenate(read("counts", np.uint8))
        if exact:
            high = np.concatenate(read("far", np.uint64))
            order = np.lexsort((high, low))  # stable: the first block comes first
            a, b = low[order], high[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            begins = np.flatnonzero(new)
            several = np.diff(np.append(begins, len(order))) > 1
            level = np.where(several[np.cumsum(new) - 1], 2 - new, 0)
        else:
            del near
            order = np.argsort(low)
            low = low[order]
            new = np.ones(len(order), bool)
            new[1:] = low[1:] != low[:-1]
            del low
            begins = np.flatnonzero(new)
            times = np.add.reduceat(count[order], begins, dtype=np.int64)
            level = np.log2(times).astype(np.uint8) + (times > 1)
            level = np.repeat(level, np.diff(np.append(begins, len(new))))
        found = np.empty(len(order), np.uint8)
        found[order] = level
        cuts = np.split(found, np.cumsum(sizes)[:-1])
        return pa.table({"shard": table.column("shard"), "block": table.column("block"),
                         "classes": pa.array([c.tobytes() for c in cuts], pa.binary())})

    dealt = encoded.mapInArrow(
        deal, "shard int, block bigint, near binary, far binary, counts binary")
    answered = dealt.groupBy("shard").applyInArrow(
        answer, "shard int, block bigint, classes binary")
    return stored(answered.groupBy("block").agg(
        F.collect_list(F.struct("shard", "classes")).alias("classes")), "census")


def levels(
    low: np.ndarray, high: np.ndarray | None, shards: int, classes
) -> np.ndarray:
    """The class of each of a block's entries, from the block's census answer."""
    _, which, _, begins = _distinct(low, high, shards)
    known = np.zeros(begins[-1], np.uint8)
    for part in classes:
        known[begins[part["shard"]]:begins[part["shard"] + 1]] = np.frombuffer(
            part["classes"], np.uint8)
    return known[which]
