"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The fingerprint of a text has 64 bits, the majority of the hashes of its word shingles. Two
fingerprints link when at most `MOST` = 3 bits differ.

A fingerprint is cut into four segments. At most three of them hold errors, so for every
linked pair some segment is equal, and one can choose it such that the next segment, cyclically,
holds at most one error: were the next one worse for every equal segment, two equal segments
would precede the same bad one. So a key is an equal segment with a fuzzy key of the next.

Fuzzy keys come from the perfect Golay code of 23 bits: every word lies within three errors of
exactly one codeword. A word has the index of that codeword as key; if it is three errors
away, also those of the five codewords four errors away. Two words one error apart share a
key: either both have the same nearest codeword, or both are three errors from their own
and four from the other's.

Equal fingerprints become one row first. Rows of a key are verified bit by bit in one task,
which returns a spanning forest of the links, not the pairs. Keys with more rows than
`SHARD_ROWS` are cut into shards: each meets the first one, and what is then not connected to
the largest part meets all shards, so no link between parts can be missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import ASCII_LOWER, stored, text_of
from folioscan.llm.components import connected
from folioscan.operators.joins import is_small, join_small

WORDS = 3
SEED = 42
MOST = 3
SEGMENTS, BITS = 4, 16
# Length, redundancy and generator polynomial of the binary Golay code.
GOLAY_BITS, CHECK_BITS, GENERATOR = 23, 11, 0b110001110101
SHARD_ROWS = 4096
KEY_ROWS = 1 << 20  # keys of a task: about 16 MB
HOT_ROWS = 10_000  # documents of one fingerprint that are spread over tasks
HOT_KEYS = 100_000
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _runs(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time."""
    data = text.encode().translate(ASCII_LOWER)
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + PIECE_BYTES)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str, size: int = WORDS, seed: int = SEED) -> int:
    """The bits that over half of the shingles' hashes have; 0 for a text without words."""
    counts, total, last = np.zeros(64, np.int64), 0, []
    for run in _runs(text):
        run = last + run
        n = len(run) - size + 1
        if n > 0:
            grams = map(b" ".join, zip(*(run[i:] for i in range(size)), strict=False))
            counts += _bit_counts(np.fromiter(
                map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n))
            total += n
        last = run[-(size - 1):] if size > 1 else []
    if not total and last:
        return xxhash.xxh64_intdigest(b" ".join(last), seed)
    return int(np.packbits(2 * counts > total).view(np.uint64)[0])


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; 0 for codewords."""
    rest = words.astype(np.int64, copy=True)
    for bit in range(GOLAY_BITS - 1, CHECK_BITS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << bit - CHECK_BITS, 0)
    return rest


def _patterns(errors: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits)
                     for bits in combinations(range(GOLAY_BITS), errors)], np.int64)


@cache
def fuzzy_keys() -> np.ndarray:
    """Per segment value: its keys, the first one always there, the others -1 where absent."""
    near = np.zeros(1 << CHECK_BITS, np.int64)
    for errors in range(1, MOST + 1):
        found = _patterns(errors)
        near[syndromes(found)] = found
    # For every syndrome of three errors, the five patterns of four with the same one.
    four = _patterns(MOST + 1)
    ranked = four[np.argsort(syndromes(four), kind="stable")].reshape(-1, 5)
    further = np.full((1 << CHECK_BITS, 5), -1, np.int64)
    further[syndromes(ranked[:, 0])] = ranked
    words = np.arange(1 << BITS, dtype=np.int64)
    at = syndromes(words)
    index = (words ^ near[at]) >> CHECK_BITS
    others = np.where(further[at] < 0, -1, (words[:, None] ^ further[at]) >> CHECK_BITS)
    return np.concatenate([index[:, None], others], axis=1)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the fingerprint of each; any link shares at least one key."""
    segment = [(prints >> np.uint64(BITS * i) & np.uint64((1 << BITS) - 1)).astype(np.int64)
               for i in range(SEGMENTS)]
    made, owner = [], []
    for i in range(SEGMENTS):
        fuzzy = fuzzy_keys()[segment[(i + 1) % SEGMENTS]]
        whole = (i << BITS | segment[i]) << GOLAY_BITS - CHECK_BITS
        there = fuzzy >= 0
        made.append((whole[:, None] | fuzzy)[there])
        owner.append(np.broadcast_to(prints[:, None], fuzzy.shape)[there])
    return np.concatenate(made), np.concatenate(owner)


def forest(prints: np.ndarray, fresh: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (positions) that connect fingerprints as all their links do.

    With `fresh`, only links of a marked row with an unmarked one are looked for.
    """
    n = len(prints)
    label = np.arange(n)
    found: list[tuple[int, int]] = []
    old = None if fresh is None else np.flatnonzero(~fresh)
    for i in range(n) if fresh is None else np.flatnonzero(fresh).tolist():
        others = slice(0, i) if old is None else old
        near = np.flatnonzero(np.bitwise_count(prints[others] ^ prints[i]) <= MOST)
        if not len(near):
            continue
        near = near if old is None else old[near]
        groups, where = np.unique(label[near], return_index=True)
        new = groups != label[i]
        if new.any():
            found += [(i, j) for j in near[where[new]].tolist()]
            label[np.isin(label, groups)] = label[i]
    return found


def _verified(rows: DataFrame, partitions: int) -> DataFrame:
    """Edges (a, b) of each (key, cell) of rows with print and fresh (null: all meet all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, cell = (batch.column(c).to_numpy() for c in ("key", "cell"))
            prints = batch.column("print").to_numpy().view(np.uint64)
            marks = batch.column("fresh")
            begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1])
                                                    | (cell[1:] != cell[:-1])]))
            sizes = np.diff(np.append(begins, len(key)))
            pairs = begins[sizes == 2]
            linked = np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= MOST
            first, second = [pairs[linked]], [pairs[linked] + 1]
            for begin, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(),
                                   strict=True):
                part = marks.slice(begin, size)
                fresh = None if part.null_count else part.to_numpy(zero_copy_only=False)
                made = np.array(forest(prints[begin:begin + size], fresh), np.int64) + begin
                if len(made):
                    first.append(made[:, 0])
                    second.append(made[:, 1])
            return pa.RecordBatch.from_arrays(
                [pa.array(prints[np.concatenate(side)].view(np.int64)) for side in (first, second)],
                names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches(
                [held, batch]).combine_chunks().to_batches()[0]
            key, cell = (whole.column(c).to_numpy() for c in ("key", "cell"))
            # The last group may go on in the next batch; it has a bounded number of rows.
            last = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1:].sum()) + 1 if (
                (key[0] != key[-1]) | (cell[0] != cell[-1])) else 0
            if last:
                yield edges(whole.slice(0, last))
            held = whole.slice(last)
        if held is not None:
            yield edges(held)

    spread = rows.select("key", "cell", "print", "fresh").repartition(
        partitions, "key", "cell").sortWithinPartitions("key", "cell")
    return spread.mapInArrow(run, "a bigint, b bigint").filter("a <> b")


def _partitions(rows: int) -> int:
    return max(8, -(-rows // KEY_ROWS))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (print) as all their links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, owner = keys(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made), pa.array(owner.view(np.int64))], names=["key", "print"])

    keyed = stored(prints.select("print").mapInArrow(run, "key bigint, print bigint"), "golay-keys")
    shards = F.ceil(F.col("count") / SHARD_ROWS).cast("int")
    hot = stored(keyed.groupBy("key").count().filter(f"count > {SHARD_ROWS}").select(
        "key", shards.alias("shards")), "golay-hot")
    few = is_small(hot)
    none = F.lit(None).cast("boolean")
    placed = join_small(keyed, hot, ["key"], F.col("print"), few, "left").withColumn(
        "shard", F.coalesce(F.pmod(F.xxhash64("print"), F.col("shards")), F.lit(0)).cast("int"))
    # Every shard with the first one of its key.
    cells = F.when((F.col("shard") == 0) & F.col("shards").isNotNull(), F.sequence(
        F.lit(0), F.col("shards") - 1)).otherwise(F.array("shard"))
    rows = keyed.count()
    found = stored(_verified(placed.select(
        "key", F.explode(cells.cast("array<bigint>")).alias("cell"), "print", none.alias("fresh")),
        _partitions(rows)).distinct(), "golay-links")
    if not hot.limit(1).count():
        return found

    # Under a hot key, what is not connected to its largest part meets all shards.
    large = stored(placed.filter("shards IS NOT NULL").select("key", "print", "shard", "shards"),
                   "golay-large")
    root = connected(found).select(F.col("node").alias("print"), "root")
    labelled = large.join(root, "print", "left").withColumn("root", F.coalesce("root", "print"))
    main = stored(labelled.groupBy("key", "root").count().groupBy("key").agg(
        F.max_by("root", F.struct("count", "root")).alias("main")), "golay-main")
    rest = stored(join_small(labelled, main, ["key"], F.col("print"), few).filter(
        "root <> main").select("key", "print", "shards"), "golay-rest")
    count = stored(rest.groupBy("key").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias(
        "rests")), "golay-rests")
    if not count.limit(1).count():
        return found
    # A cell is a part of the rest against a shard; rows of the rest also stand in their shards.
    as_rest = join_small(rest, count, ["key"], F.col("print"), few).select(
        "key", "print", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("print", F.lit(1)), F.col("rests")).cast("int").alias("part"),
        F.lit(True).alias("fresh"))
    as_row = join_small(large, count, ["key"], F.col("print"), few).select(
        "key", "print", "shard", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("part"),
        F.lit(False).alias("fresh"))
    met = as_rest.unionByName(as_row).withColumn(
        "cell", F.col("part").cast("bigint") * (1 << 31) + F.col("shard"))
    more = _verified(met, _partitions(rows))
    return stored(found.unionByName(more).distinct(), "golay-links")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable by links, its own included. Words are
    `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer than three words has its whole
    sequence as one shingle, and one without words, empty or null has fingerprint zero, which
    links like any other. A row per row of `docs`: repeated rows link with one another. A
    null id never names a component, unless the component has no other. Only the two named
    columns are read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("body"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time leaves the Arrow buffer.
            made = [fingerprint(t.as_py()) for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(made, np.uint64).view(np.int64))],
                names=["id", "print"])

    printed = stored(rows.mapInArrow(run, f"id {kind}, print bigint"), "golay-prints")
    classes = stored(printed.groupBy("print").agg(
        F.min("id").alias("first"), F.count("*").alias("held")), "golay-classes")
    root = stored(connected(links(classes)).select(F.col("node").alias("print"), "root"),
                  "golay-roots")
    linked = root.join(classes.select("print", "first"), "print")
    least = stored(linked.groupBy("root").agg(F.min("first").alias("least")), "golay-least")
    joined = join_small(linked, least, ["root"], F.col("print"), is_small(least)).select(
        "print", "least")
    named = stored(classes.join(joined, "print", "left").select(
        "print", "held", F.coalesce("least", "first").alias("component_id")), "golay-named")
    # Documents of a frequent fingerprint stay where they are; such fingerprints are few.
    total = named.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(named.filter(F.col("held") > bound).select("print", "component_id"))
    cold = named.filter(F.col("held") <= bound).select("print", "component_id")
    answered = printed.join(hot, "print").unionByName(
        printed.join(hot, "print", "left_anti").join(cold, "print"))
    return answered.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
