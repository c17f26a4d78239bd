"""Removal of byte strings that occur more than once in a corpus, by previous factors.

The longest-previous-factor array of a text says, for every position, how long a match
begins there that also begins earlier. It follows from suffix order: of all earlier
positions, the nearest ones before and after a suffix in that order (its previous and next
smaller positions) share the most with it. A position is a later copy of `length` bytes
exactly if its entry reaches `length`.

A corpus is too large for one suffix order, so positions are sorted out first:

1. In every window of `length` bytes one place is the anchor: the least hash of a few bytes.
   Equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor
   form a run. A census over hashes tells which anchors occur more than once; windows of all
   other runs occur once and are done.
2. Runs with equal bytes are copies of one another. Of every distinct run only one place is
   kept, and only where other runs share its anchor can single windows still repeat. Those
   runs are cut at fixed distances from the anchor, and the cuts are judged the same way by
   the bytes that all their windows share.
3. The windows of what stays open are put in suffix order, block by block, and previous factors
   reduce a block to the first place of each window. A census of the remaining windows joins
   the blocks: who has a window that another block has, and which block has it first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.census import Block, block_rows, census, levels
from folioscan.llm.common import blocks, bucketed, mixed, stored, text_of

BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 19  # of text whose hashes are held at once
GRAM = 32
CUT = 16  # windows in a part of a run
DATA = ("data", "starts", "counts", "offsets", "anchors", "digests")
SHARD_BYTES = 48 << 20  # of text whose entries one census shard gets
# Spark allows 100,000; beyond, a bucket has several blocks, which are still read one by one.
MOST_BUCKETS = 50_000


def longest_previous_factors(order: list[int], common: list[int]) -> list[int]:
    """By rank: the longest match of each suffix with one that starts earlier.

    `order` has the start positions in suffix order, `common[i]` the length that ranks
    i - 1 and i share. A stack holds ranks whose next smaller position is still to come.
    """
    found = [0] * len(order)
    stack: list[tuple[int, int]] = []  # rank, and what it shares with the rank below it
    for rank, position in enumerate(order):
        shared = common[rank] if rank else 0
        while stack and order[stack[-1][0]] > position:
            above, below = stack.pop()
            # The current rank is its next smaller position, the rank below its previous one.
            found[above] = max(found[above], shared, below)
            shared = min(shared, below)
        stack.append((rank, shared))
    for rank, below in stack:
        found[rank] = max(found[rank], below)
    return found


def suffix_order(buffer: np.ndarray, starts: np.ndarray, length: int):
    """The starts in the order of their first `length` bytes, and what neighbours share."""
    windows = np.lib.stride_tricks.sliding_window_view(buffer, length)[starts]
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    shared = np.zeros(len(order), np.int64)
    for cut in range(1, len(order), 1 << 16):
        to = min(len(order), cut + (1 << 16))
        differ = windows[order[cut - 1:to - 1]] != windows[order[cut:to]]
        shared[cut:to] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return order, shared


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima of whole stretches."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def runs(buffer: np.ndarray, ends: np.ndarray, length: int):
    """Runs of windows: first start, number of windows, anchor's distance, anchor's hash.

    `ends` are the ends of the texts in the buffer; windows lie within one text.
    """
    gram = min(GRAM, length)
    starts, counts, offsets, anchors = [], [], [], []
    for begin in range(0, max(0, len(buffer) - length + 1), PIECE_BYTES):
        piece = buffer[begin:begin + PIECE_BYTES + length - 1].astype(np.uint64)
        hashed, size = piece + np.uint64(1), 1
        with np.errstate(over="ignore"):
            while size < gram:  # double the hashed length, with an overlap at the end
                step = min(size, gram - size)
                hashed = hashed[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) ^ (
                    hashed[step:] >> np.uint64(7)) + hashed[step:]
                size += step
        hashed = mixed(hashed)
        place = np.arange(len(hashed), dtype=np.uint64)
        least = _least(hashed & np.uint64(0xFFFFFFFF00000000) | place, length - gram + 1)
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(len(anchor)) + begin
        text = np.searchsorted(ends, start, "right")
        inside = start + length <= ends[np.minimum(text, len(ends) - 1)]
        start, anchor, text = start[inside], anchor[inside], text[inside]
        if not len(start):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        starts.append(start[first])
        counts.append(np.diff(np.append(first, len(start))))
        offsets.append(anchor[first] + begin - start[first])
        anchors.append(hashed[anchor[first]])
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(map(np.concatenate, (starts, counts, offsets, anchors)))


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    view = memoryview(data)
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(
            starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def _encoded(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blocks of texts with their runs, in buckets by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for number, block in enumerate(blocks(batches, "body", BLOCK_BYTES)):
            texts = [t.encode() for t in block.column("body").to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            data = b"".join(texts)
            starts, counts, offsets, anchors = runs(
                np.frombuffer(data, np.uint8), np.cumsum(lengths), length)
            ids = block.column("id").combine_chunks()
            packed = [pack.compress(data), starts.astype(np.int32), counts.astype(np.int32),
                      offsets.astype(np.int32), anchors,
                      _digests(data, starts, starts + counts + length - 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([lengths], pa.list_(pa.int64())),
                *(pa.array([x if isinstance(x, bytes) else x.tobytes()]) for x in packed),
            ], names=["block", "ids", "lengths", *DATA])

    kind = rows.schema["id"].dataType.simpleString()
    return bucketed(rows.mapInArrow(
        run, f"block bigint, ids array<{kind}>, lengths array<bigint>, "
        + ", ".join(f"{n} binary" for n in DATA)), "block", buckets, "repeat-blocks")


def _units(core: np.ndarray, digest: np.ndarray, block: int, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(core[at].view(np.int64)), pa.array(digest[at].view(np.int64)),
        pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)),
    ], names=["core", "digest", "block", "unit"])


_UNITS = "core bigint, digest bigint, block bigint, unit int"


def _shared_runs(encoded: DataFrame, shards: int) -> DataFrame:
    """The runs whose anchor may occur elsewhere."""
    counted = census(encoded.select("block", "anchors"),
                     lambda block: block.array("anchors", np.uint64), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in block_rows(batches):
            anchors = block.array("anchors", np.uint64)
            at = np.flatnonzero(levels(anchors, None, shards, block.list("classes")))
            yield _units(anchors, block.array("digests", np.uint64), block.number, at)

    return encoded.select("block", "anchors", "digests").join(counted, "block").mapInArrow(
        run, _UNITS)


class _Parts:
    """Parts of a block's open runs: windows of about equal distance to the anchor."""

    def __init__(self, block: Block, length: int):
        self.length = length
        marks = _marks(block, "marks")
        at = marks[marks[:, 3] == 1, 0]
        starts, counts, offsets = (
            block.array(n, np.int32)[at] for n in ("starts", "counts", "offsets"))
        # Distances fall from `offsets` to `offsets - counts + 1` along a run.
        high, low = offsets // CUT, (offsets - counts + 1) // CUT
        pieces = high - low + 1
        of = np.repeat(np.arange(len(at)), pieces)
        grid = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        anchor = starts[of] + offsets[of]
        self.starts = np.maximum(starts[of], anchor - grid * CUT - CUT + 1)
        stop = np.minimum(starts[of] + counts[of], anchor - grid * CUT + 1)
        self.counts = stop - self.starts
        self.near = anchor - grid * CUT  # the bytes from here belong to all windows
        self.grid = grid

    def units(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        core = _digests(data, self.near, self.near + self.length - CUT + 1)
        full = _digests(data, self.starts, self.starts + self.counts + self.length - 1)
        return mixed(core ^ self.grid.astype(np.uint64)), full


def _shared_parts(opened: DataFrame, length: int) -> DataFrame:
    """The parts of open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in block_rows(batches):
            core, full = _Parts(block, length).units(block.data())
            yield _units(core, full, block.number, np.arange(len(core)))

    return opened.mapInArrow(run, _UNITS)


def _judged(units: DataFrame, name: str) -> DataFrame:
    """block and, per unit: has copies, is the first of them, may have windows elsewhere.

    A digest names bytes only together with the core, so 128 bits tell units apart.
    """
    distinct = units.groupBy("core", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("block", "unit")).alias("first"))
    kinds = distinct.groupBy("core").agg(F.count("*").alias("kinds"))
    judged = distinct.join(kinds, "core").filter("copies > 1 OR kinds > 1")
    here = F.col("first") == F.struct("block", "unit")
    return units.join(judged, ["core", "digest"]).select(
        "block", F.struct(
            "unit", (F.col("copies") > 1).alias("copied"), here.alias("first"),
            ((F.col("kinds") > 1) & here).alias("open")).alias("mark"),
    ).groupBy("block").agg(F.collect_list("mark").alias(name))


def _marks(block: Block, name: str) -> np.ndarray:
    """Rows of unit, copied, first, open; by unit."""
    found = block.values(name)
    if found is None:
        return np.zeros((0, 4), np.int64)
    columns = [found.field(n) for n in ("unit", "copied", "first", "open")]
    made = np.stack([c.cast(pa.int64()).to_numpy() for c in columns], 1)
    return made[np.argsort(made[:, 0])]


class _OpenWindows:
    """The windows of a block's open parts, their classes, and the first place of each class."""

    def __init__(self, block: Block, length: int):
        marks, parts = _marks(block, "parts"), _Parts(block, length)
        at = marks[marks[:, 3] == 1, 0]
        starts, counts = parts.starts[at], parts.counts[at]
        self.starts = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(
            counts.sum())
        data = block.data()
        buffer = np.frombuffer(data, np.uint8)
        if not len(self.starts):
            self.later = np.zeros(0, bool)
            self.kind = self.first = np.zeros(0, np.int64)
            self.low = self.high = np.zeros(0, np.uint64)
            return
        order, shared = suffix_order(buffer, self.starts, length)
        factors = longest_previous_factors(self.starts[order].tolist(), shared.tolist())
        self.later = np.zeros(len(order), bool)  # a copy of an earlier window in the block
        self.later[order] = np.array(factors) >= length
        self.kind = np.zeros(len(order), np.int64)
        self.kind[order] = np.cumsum(shared < length) - 1
        self.first = np.flatnonzero(~self.later)
        self.first = self.first[np.argsort(self.kind[self.first])]
        view = memoryview(data)
        digest = np.frombuffer(b"".join(
            xxhash.xxh3_128_digest(view[s:s + length]) for s in self.starts[self.first].tolist()
        ), np.uint64).reshape(-1, 2)
        self.low, self.high = digest[:, 0].copy(), digest[:, 1].copy()


def find_repeats(
    docs: DataFrame, length: int = 200, keep_first: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document the bytes to remove: id, n_bytes, spans of (start, end), kept.

    A byte is removed if a string of `length` bytes covers it that starts anywhere else too,
    in the same document or another; with `keep_first`, only if it starts earlier (in the
    order of the blocks that were read). Strings lie within one text, overlaps count, and all
    are judged on the input. Spans are maximal and in order; `kept` are the bytes that stay.
    A row per row of `docs`: repeated rows are copies of each other, a null text is empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    shards = max(8, -(-size // SHARD_BYTES))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = _encoded(rows, length, min(max(partitions, shards), MOST_BUCKETS))
    marks = stored(_judged(stored(_shared_runs(encoded, shards), "repeat-runs"), "marks"),
                   "repeat-marks")
    # Only blocks with open units take part in what follows.
    opened = encoded.select("block", "data", "starts", "counts", "offsets").join(
        marks.filter(F.exists("marks", lambda m: m["open"])), "block")
    parts = stored(_judged(stored(_shared_parts(opened, length), "repeat-parts"), "parts"),
                   "repeat-marks")

    def open_windows(block: Block):
        found = _OpenWindows(block, length)
        return found.low, found.high

    windows = census(opened.join(parts.filter(F.exists("parts", lambda m: m["open"])), "block"),
                     open_windows, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in block_rows(batches):
            data = block.data()
            starts, counts = block.array("starts", np.int32), block.array("counts", np.int32)
            change = np.zeros(len(data) + 1, np.int64)

            def cover(first: np.ndarray, count: np.ndarray, change=change) -> None:
                np.add.at(change, first, 1)
                np.add.at(change, first + count + length - 1, -1)

            cut = _Parts(block, length)
            for name, first, count in (("marks", starts, counts),
                                       ("parts", cut.starts, cut.counts)):
                found = _marks(block, name)
                whole = found[(found[:, 1] == 1) & ~((found[:, 2] == 1) & keep_first), 0]
                cover(first[whole], count[whole])
            opened = _OpenWindows(block, length)
            if len(opened.starts):
                level = levels(opened.low, opened.high, shards, block.list("windows"))
                if keep_first:
                    gone = opened.later | (level == 2)[opened.kind]
                else:
                    several = np.bincount(opened.kind, minlength=len(level)) > 1
                    gone = (several | (level > 0))[opened.kind]
                at = opened.starts[gone]
                cover(at, np.ones(len(at), np.int64))
            removed = np.cumsum(change)[:-1] > 0
            lengths = block.values("lengths").to_numpy()
            ends = np.cumsum(lengths)
            spans, kept = [], []
            for begin, end in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                edge = np.flatnonzero(np.diff(removed[begin:end], prepend=False, append=False))
                pairs = edge.reshape(-1, 2).tolist()
                text, parts, last = data[begin:end], [], 0
                for a, b in pairs:
                    parts.append(text[last:a])
                    last = b
                parts.append(text[last:])
                spans.append([{"start": a, "end": b} for a, b in pairs])
                kept.append(b"".join(parts))
            full = pa.table([
                block.values("ids"), pa.array(lengths),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ], names=["id", "n_bytes", "spans", "kept"])
            yield from full.to_batches(max_chunksize=1024)

    judged = encoded.drop("anchors", "digests").join(marks, "block", "left").join(
        parts, "block", "left").join(
        windows.withColumnRenamed("classes", "windows"), "block", "left")
    return judged.mapInArrow(
        run, f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, "
             "kept binary").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What `find_repeats` removes, in figures: n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select(
        id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
