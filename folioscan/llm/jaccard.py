"""Exact Jaccard join of documents by word n-grams, as blocked sparse matrix products.

1. Each document becomes a row of the incidence matrix, its set of hashed n-grams. How many
   documents hold an n-gram is counted in shards of the hash range; a shard sees four bytes
   per entry, so a count may be too high, never too low.
2. With similarity of at least t, a set of n shares at least t*n entries with its partner.
   A document with fewer entries that occur elsewhere has none and is settled. Of the rest,
   the n - ceil(t*n) + 1 rarest entries must meet one of the partner's: the prefix.
3. Equal sets become one row. Rows that share a prefix entry belong to one candidate group.
   Links of each row with one centre per entry are enough to form the groups.
4. A group is multiplied in blocks: overlap counts of all its rows are accumulated entry by
   entry, and pairs below the bound that follows from both sizes are discarded. A group
   larger than a block is cut into shards; each meets the first shard. What is then not yet
   connected to the largest part meets all shards, so no link between parts can be missed.

Nothing here emits all pairs of a group: blocks return the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.census import Block, block_rows, census, levels
from folioscan.llm.common import blocks, mixed, stored, text_of, words
from folioscan.llm.components import connected

WORDS = 5
PERCENT = 75
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 24 << 20  # of text whose n-grams one counting shard gets
SHARD_ROWS = 1000  # documents in a block of a product
BROADCAST_ROWS = 1_000_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The sorted distinct n-gram hashes of a document, given its word hashes."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    count = len(hashes) - size + 1
    made = np.full(count, size, np.uint64)
    for j in range(size):
        made = mixed(made ^ hashes[j:j + count])
    return np.unique(made)


def needed(n: int) -> int:
    """The least number of its entries that a set of n shares with a partner."""
    return -(-PERCENT * n // 100)


def _encoded(rows: DataFrame) -> DataFrame:
    """Blocks of documents as word numbers: block, ids, lengths, numbers, vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in enumerate(blocks(batches, "body", BLOCK_BYTES)):
            known = _Numbers()
            flat = [np.array([*map(known.__getitem__, words(t))], np.int32)
                    for t in block.column("body").to_pylist()]
            ids = block.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([[len(f) for f in flat]], pa.list_(pa.int32())),
                pa.array([np.concatenate(flat).tobytes()], pa.binary()),
                pa.array([b" ".join(known)], pa.binary()),
            ], names=["block", "ids", "lengths", "numbers", "vocabulary"])

    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"block bigint, ids array<{kind}>, lengths array<int>, "
                                       "numbers binary, vocabulary binary"), "jaccard-blocks")


def _sets(block: Block) -> list[np.ndarray]:
    """The n-gram sets of one block's documents."""
    vocabulary = block.array("vocabulary", np.uint8).tobytes().split(b" ")
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    flat = hashed[block.array("numbers", np.int32)]
    ends = np.cumsum(block.values("lengths").to_numpy().astype(np.int64))
    return [shingles(part) for part in np.split(flat, ends[:-1])] if len(ends) else []


def _joined(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _candidates(encoded: DataFrame, rarity: DataFrame, shards: int, id_type: str) -> DataFrame:
    """A row per document: id, n, and for those that may have partners key, entries, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in block_rows(batches):
            sets = _sets(block)
            level = levels(_joined(sets), None, shards, block.list("classes"))
            keys, kept, prefixes = [], [], []
            begin = 0
            for entries in sets:
                n = len(entries)
                rare = level[begin:begin + n]
                begin += n
                if not n or np.count_nonzero(rare) < needed(n):
                    keys.append(None), kept.append(None), prefixes.append(None)
                    continue
                data = entries.tobytes()
                ranked = np.lexsort((entries, rare))[:n - needed(n) + 1]
                shared = ranked[rare[ranked] > 0]
                keys.append(xxhash.xxh3_128_digest(data))
                kept.append(data)
                prefixes.append(entries[shared].view(np.int64))
            for cut in range(0, len(sets), 1024):
                to = slice(cut, cut + 1024)
                yield pa.RecordBatch.from_arrays([
                    block.values("ids")[to],
                    pa.array([len(s) for s in sets[to]], pa.int64()),
                    pa.array(keys[to], pa.binary()), pa.array(kept[to], pa.binary()),
                    pa.array(prefixes[to], pa.list_(pa.int64())),
                ], names=["id", "n", "key", "entries", "prefix"])

    return stored(encoded.join(rarity, "block", "left").mapInArrow(
        run, f"id {id_type}, n bigint, key binary, entries binary, prefix array<bigint>"),
        "jaccard-sets")


def links(rows: list[np.ndarray], fresh: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect rows as all their links do; the product of one block.

    With `fresh`, only links of a marked row with an unmarked one are looked for. Overlaps
    of a row with all others are accumulated from the postings of its entries.
    """
    n = len(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    entries = np.concatenate(rows)
    order = np.argsort(entries, kind="stable")
    ranked = entries[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    which = np.empty(len(entries), np.int64)
    which[order] = np.cumsum(first) - 1
    begins = np.append(np.flatnonzero(first), len(ranked))
    posting = owner[order]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found: list[tuple[int, int]] = []
    row_begins = np.cumsum(sizes) - sizes
    for i in range(n):
        if fresh is not None and not fresh[i]:
            continue
        if fresh is None and i == 0:
            continue
        mine = which[row_begins[i]:row_begins[i] + sizes[i]]
        starts, counts = begins[mine], begins[mine + 1] - begins[mine]
        keep = counts > 1
        starts, counts = starts[keep], counts[keep]
        if not len(starts):
            continue
        spots = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        overlap = np.bincount(posting[spots], minlength=n)
        linked = (100 + PERCENT) * overlap >= PERCENT * (sizes + sizes[i])
        linked[i] = False
        if fresh is None:
            linked[i:] = False
        else:
            linked &= ~fresh
        for j in np.flatnonzero(linked & (overlap > 0)).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                found.append((i, j))
    return found


def _products(placed: DataFrame) -> DataFrame:
    """Edges (a, b) found in each block: rows of group, cell, key, entries, fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, rows, fresh = None, [], [], []

        def finish() -> pa.RecordBatch:
            marks = np.array(fresh, bool) if any(f is not None for f in fresh) else None
            made = links(rows, marks) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[e[k]] for e in made], pa.binary()) for k in (0, 1)],
                names=["a", "b"])

        for batch in batches:
            for group, part, key, entries, mark in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if (group, part) != cell:
                    if rows:
                        yield finish()
                    cell, keys, rows, fresh = (group, part), [], [], []
                keys.append(key)
                rows.append(np.frombuffer(entries, np.uint64))
                fresh.append(mark)
        if rows:
            yield finish()

    spread = placed.repartition("group", "cell").sortWithinPartitions("group", "cell")
    return spread.select("group", "cell", "key", "entries", "fresh").mapInArrow(
        run, "a binary, b binary")


def _edges(sets: DataFrame) -> DataFrame:
    """A spanning forest of the links between distinct sets (key, entries, prefix)."""
    entries = sets.select("key", F.explode("prefix").alias("entry"))
    centre = entries.groupBy("entry").agg(
        F.min("key").alias("centre"), F.count("*").alias("holders")
    ).filter("holders > 1").drop("holders")
    star = entries.join(centre, "entry").filter("key <> centre").select(
        F.col("key").alias("a"), F.col("centre").alias("b")).distinct()
    group = stored(connected(star).select(F.col("node").alias("key"), F.col("root").alias(
        "group")), "jaccard-groups")
    size = group.groupBy("group").agg(F.count("*").alias("rows"))
    shards = F.ceil(F.col("rows") / SHARD_ROWS).cast("int")
    member = stored(
        sets.select("key", "entries").join(group, "key").join(size, "group").withColumn(
            "shards", shards
        ).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")),
        "jaccard-members")

    # Every shard with the first one of its group.
    cells = F.when(F.col("shard") == 0, F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(
        F.array("shard"))
    none = F.lit(None).cast("boolean")
    found = stored(_products(member.select(
        "group", F.explode(cells).alias("cell"), "key", "entries", none.alias("fresh"))),
        "jaccard-links")

    large = member.filter("shards > 1")
    if not large.limit(1).count():
        return found
    # In a group of several shards, what is not connected to its largest part meets the rest.
    part = connected(found)
    labelled = large.drop("entries").join(
        part.select(F.col("node").alias("key"), "root"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    largest = labelled.groupBy("group", "root").agg(F.count("*").alias("rows")).groupBy(
        "group").agg(F.max_by("root", F.struct("rows", "root")).alias("main"))
    rest = stored(
        labelled.join(largest, "group").filter("root <> main").select("group", "key"),
        "jaccard-rest")
    count = rest.groupBy("group").agg(
        F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("rests"))
    busy = large.join(count, "group").join(
        rest.withColumn("is_rest", F.lit(True)), ["group", "key"], "left")
    # A cell is a part of the rest against a shard; a row of the rest also stands in its
    # own shard, so that it meets other rows of the rest.
    as_rest = busy.filter("is_rest").select(
        "group", "key", "entries", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias(
            "shard"),
        F.pmod(F.xxhash64("key", F.lit(1)), F.col("rests")).cast("int").alias("part"),
        F.lit(True).alias("fresh"))
    as_row = busy.select(
        "group", "key", "entries", "shard",
        F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("part"),
        F.lit(False).alias("fresh"))
    cell = F.col("part").cast("bigint") * (1 << 31) + F.col("shard")
    more = _products(as_rest.unionByName(as_row).withColumn("cell", cell))
    return found.unionByName(more.filter("a <> b"))


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest id that links lead to.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer than five words has
    its whole sequence as one n-gram, a null or empty text has none and no links. Documents
    link at a Jaccard similarity of 0.75 or more. A row per row of `docs`: repeated rows are
    copies of one another. A null id never names a component; a document without an id gets
    the id of its component, or null where there is none.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    shards = max(8, -(-size // SHARD_BYTES))
    encoded = _encoded(rows)
    counted = census(encoded, lambda block: _joined(_sets(block)), shards)
    judged = _candidates(encoded, counted, shards, kind)
    some = judged.filter("key IS NOT NULL")
    sets = some.select("key", "entries", "prefix").dropDuplicates(["key"])
    root = connected(_edges(sets))
    rooted = some.select("key", "id").join(
        root.select(F.col("node").alias("key"), "root"), "key", "left"
    ).select("key", F.coalesce("root", "key").alias("root"), "id")
    first = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id"))
                   .join(rooted.select("root", "key").distinct(), "root")
                   .select("key", "component_id"), "jaccard-components")
    return judged.select("id", "n", "key").join(first, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False
) -> DataFrame:
    """`docs` with one row of each group of links: the one with the smallest id, nulls last.

    Rows are told apart by themselves, not by their ids, so rows that share an id but no
    text all stay. Rows without any words link with nothing and stay. Same columns.
    `from_files` says that `docs` is a plain read of files, whose rows come alike each time;
    otherwise the numbered rows are stored once, as a shuffle may deal them anew.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"),
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"),
        F.monotonically_increasing_id().alias("row_no"))
    if not from_files:
        rows = stored(rows, "jaccard-rows")
    found = components(rows, "row_no", "body").select("row_no", "component_id")
    size = found.groupBy("component_id").count().filter("count > 1").drop("count")
    grouped = stored(found.join(size, "component_id").join(
        rows.select("row_no", F.struct(F.col("id").isNull(), "id", "row_no").alias("rank")),
        "row_no"), "jaccard-grouped")
    stays = grouped.groupBy("component_id").agg(F.min("rank")["row_no"].alias("stays"))
    leaves = stored(grouped.join(stays, "component_id").filter("row_no <> stays").select(
        "row_no"), "jaccard-leaves")
    # Row numbers only; beyond the bound both sides are shuffled instead.
    few = leaves.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(leaves) if few else leaves, "row_no", "left_anti").select(
        *(F.col("kept")[c].alias(c) for c in docs.columns))
