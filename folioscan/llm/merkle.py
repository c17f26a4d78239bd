"""Merkle manifest of a dataset: a hash tree over all rows, membership proofs and folds.

A row is a leaf, the SHA-256 of its fields. The leaves of a group (a language) stand in the
order of their ids; every `FAN` consecutive nodes become the hash of their concatenated hex
digests, until one node remains, the group's subroot. Subroots, in the order of their
groups, become the root in the same way.

While a parent is hashed it retains a copy of the hash state before each child. Folding a
changed child resumes the state at its slot with the replacement and the siblings to the
right of it only; nothing to the left is hashed again.

On Spark: leaves are hashed in the scan and range-sorted by group and id, so that counts per
partition give every leaf its place. `FAN ** LEVELS` consecutive nodes are a block, one row,
whose levels are built in one call; the tops of blocks are the nodes of the next step. Paths
come back down the same blocks: each block is joined with the one path of its top, never with
paths per leaf. A hash state cannot leave its process, so a block resumes the states above
itself from the siblings to the left, once for all its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import stored
from folioscan.operators.joins import is_small, join_small

FAN = 8
LEVELS = 4  # of a block, which has FAN ** LEVELS nodes
PART_ROWS = 1 << 17  # nodes of a task: about 20 MB
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Step = tuple[str, str]  # the siblings before and after a node


class Parent:
    """A node above the leaves: its digest, and the hash state before each child."""

    __slots__ = ("digest", "sides", "states")

    def __init__(self, children: list[str]):
        state = sha256()
        self.states = []
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()
        self.sides: list[Step] = [
            ("".join(children[:i]), "".join(children[i + 1:])) for i in range(len(children))]

    def fold(self, slot: int, replacement: str) -> str:
        """The digest with another child in a slot."""
        return resumed(self.states[slot], replacement, self.sides[slot][1])


def resumed(state, child: str, after: str) -> str:
    """The digest of a parent from a retained state, a child and its right siblings."""
    state = state.copy()
    state.update(child.encode())
    state.update(after.encode())
    return state.hexdigest()


def fold(leaf: str, proof: list[Step]) -> str:
    """The root that a leaf and its proof lead to; verifies one row without the dataset."""
    for before, after in proof:
        leaf = resumed(sha256(before.encode()), leaf, after)
    return leaf


def height(nodes: int) -> int:
    """Levels until one of so many nodes remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def parents(nodes: list[str], levels: int) -> list[list[Parent]]:
    """So many levels of parents above consecutive nodes."""
    found = []
    for _ in range(levels):
        found.append([Parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in found[-1]]
    return found


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of all fields: `-` for null, else UTF-8 byte count, `:`, value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _partitions(rows: int) -> int:
    return -(-rows // PART_ROWS) or 1


def _placed(rows: DataFrame, order: list[str], partitions: int) -> tuple[DataFrame, int]:
    """`rows` with place and size in their tree, from 0 by `order`; the largest size."""
    spread = rows.repartitionByRange(partitions, "tree", *order).sortWithinPartitions(
        "tree", *order)
    kept = stored(spread.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    kept = kept.withColumn("part", F.shiftright("at", 33)).withColumn(
        "at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # At most one row per partition and one more per tree.
    tree = Window.partitionBy("tree")
    ahead = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(
        kept.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
        .select("tree", "part", F.sum("held").over(tree).alias("size"),
                (F.coalesce(F.sum("held").over(ahead), F.lit(0)) - F.col("first")).alias("shift")),
        "merkle-runs")
    most = runs.agg(F.max("size")).first()[0] or 0
    placed = join_small(kept, runs, ["tree", "part"], F.col("at"), is_small(runs))
    return placed.withColumn("place", F.col("at") + F.col("shift")), most


def _blocks(nodes: DataFrame, partitions: int, levels: int) -> DataFrame:
    """A row per block of nodes (tree, size, place, id, node, changed), with its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for size, row in zip(batch.column("size").to_pylist(),
                                 batch.column("nodes").to_pylist(), strict=True):
                above = parents(row, min(levels, height(size)))
                tops.append(above[-1][0].digest if above else row[0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tops, pa.string())], names=[*batch.schema.names, "top"])

    block = F.expr(f"place div {FAN ** levels}").alias("block")
    rows = nodes.select("tree", "size", block, F.struct("place", "id", "node", "changed").alias("n"))
    # At most FAN ** levels rows of a key are collected.
    grouped = rows.repartition(partitions, "tree", "block").groupBy("tree", "block").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list("n")).alias("n")
    ).select("tree", "block", "size", F.col("n.id").alias("ids"), F.col("n.node").alias("nodes"),
             F.col("n.changed").alias("changes"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
    return stored(grouped.mapInArrow(run, f"{schema}, top string"), "merkle-blocks")


def _climbed(
    nodes: DataFrame, rows: int, most: int, levels: int
) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The blocks of every step until each tree has one node, and those nodes."""
    steps, span = [], FAN ** levels
    while True:
        partitions = _partitions(rows)
        blocks = _blocks(nodes, partitions, levels)
        steps.append((blocks, partitions))
        nodes = blocks.select(
            "tree", F.ceil(F.col("size") / span).alias("size"), F.col("block").alias("place"),
            F.col("block").alias("id"), F.col("top").alias("node"),
            F.lit(None).cast("string").alias("changed"))
        most = -(-most // span)
        if most <= 1:
            return steps, nodes
        rows = nodes.count()


def _paths(blocks: DataFrame, levels: int) -> DataFrame:
    """A row per node of blocks that carry their top's path, subroot and root.

    tree, place, id, node, path (steps from the node to the root), subroot, root, and
    folded, the root that the changed node leads to (the node itself where none is given).
    """
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = (f"tree string, place bigint, id {kind}, node string, path array<struct<before: "
              "string, after: string>>, subroot string, root string, folded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                yield unfolded(row, batch.column("ids")[at].values)

    def unfolded(row: dict, ids: pa.Array) -> pa.RecordBatch:
        nodes = row["nodes"]
        inside = parents(nodes, min(levels, height(row["size"])))
        outside = [(s["before"], s["after"]) for s in row["path"]]
        above = [(sha256(before.encode()), after) for before, after in outside]
        before, after, folded = [], [], []
        for place, (node, changed) in enumerate(zip(nodes, row["changes"], strict=True)):
            node = node if changed is None else changed
            for level in inside:
                place, slot = divmod(place, FAN)
                side = level[place].sides[slot]
                before.append(side[0])
                after.append(side[1])
                node = level[place].fold(slot, node)
            for state, siblings in above:
                node = resumed(state, node, siblings)
            before += [b for b, _ in outside]
            after += [a for _, a in outside]
            folded.append(node)
        n, steps = len(nodes), len(inside) + len(outside)
        path = pa.ListArray.from_arrays(
            pa.array(range(0, n * steps + 1, steps) if steps else [0] * (n + 1), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=["before", "after"]))
        first = row["block"] * FAN ** levels
        return pa.RecordBatch.from_arrays([
            pa.array([row["tree"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
            ids, pa.array(nodes, pa.string()), path, pa.array([row["subroot"]] * n, pa.string()),
            pa.array([row["root"]] * n, pa.string()), pa.array(folded, pa.string()),
        ], names=["tree", "place", "id", "node", "path", "subroot", "root", "folded"])

    return blocks.mapInArrow(run, schema)


def _descended(
    steps: list[tuple[DataFrame, int]], above: DataFrame, levels: int
) -> DataFrame:
    """Paths of the nodes of the first step, given those of the tops of the last one."""
    for number, (blocks, partitions) in enumerate(reversed(steps), 1):
        upper = above.select("tree", F.col("place").alias("block"), "path", "subroot", "root")
        above = _paths(blocks.repartition(partitions, "tree", "block").join(
            upper, ["tree", "block"]).drop("top"), levels)
        if number < len(steps):
            above = stored(above, "merkle-paths")
    return above


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS, changes: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """Per row: its leaf, its group's subroot, the root, its proof, and a fold.

    `changes` gives fields another value in a second reading of the rows; folded_root is the
    root that the second leaf leads to with the siblings of the first reading, and verified
    tells whether it is the root. proof lists, from leaf to root, the siblings before and
    after the node as concatenated hex digests (both empty where a run has one node).

    Null fields are `-`, an empty text `0:`; null groups and null ids come first. Rows of one
    id stand in the order of their leaves; equal rows are separate leaves. A single row is
    its own subroot and root, with an empty proof. No rows give no rows. Only the named
    columns are read, so extra ones can bear any name.
    """
    def column(name: str) -> Column:
        return F.col(f"`{name}`")

    changes = changes or {}
    group = column(group_col).cast("string")
    leaves = stored(docs.select(
        # Without nulls, and with the null group before all others.
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        column(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"),
        leaf_digest([column(f) for f in fields]).alias("node"),
        leaf_digest([changes.get(f, column(f)) for f in fields]).alias("changed"),
    ), "merkle-leaves")
    rows = leaves.count()
    placed, most = _placed(leaves, ["id", "node", "row_no"], _partitions(rows))
    steps, subroots = _climbed(placed, rows, most, levels)
    groups = stored(subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("id"), "node", "changed"), "merkle-groups")
    rows = groups.count()
    ranked, most = _placed(groups, ["id"], _partitions(rows))
    group_steps, roots = _climbed(ranked, rows, most, levels)
    none = F.lit(None).cast("string")
    top = roots.select(
        "tree", "place", F.array().cast("array<struct<before: string, after: string>>").alias(
            "path"), none.alias("subroot"), F.col("node").alias("root"))
    above = stored(_descended(group_steps, top, levels).select(
        F.col("id").alias("tree"), F.lit(0).cast("bigint").alias("place"), "path",
        F.col("node").alias("subroot"), "root"), "merkle-subroots")
    return _descended(steps, above, levels).select(
        F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root",
        F.col("path").alias("proof"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The manifest with the SHA-256 of each proof's digests in place of the proof."""
    siblings = F.transform("proof", lambda s: F.concat(s["before"], s["after"]))
    return found.select(
        id_col, "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", "verified")


def oracle(fan: int = FAN) -> str:
    """The SQL of the contract's query, with CRC-32 of decimal ids bit by bit."""
    # Per byte, eight steps of the reflected polynomial.
    crc = (
        "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS "
        "VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda a, d: list_reduce([xor(a, d)] "
        "|| CAST(range(8) AS BIGINT[]), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN "
        "3988292384 ELSE 0 END))))")

    def leaf(text: str) -> str:
        parts = " || ".join(
            f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')"
            for f in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({parts})"

    lowered = ("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

    def climb(name: str, start: str) -> str:
        """All levels of all trees, from (tree, node, place, size)."""
        return f"""
        {name} AS (
          SELECT 0 AS level, * FROM ({start})
          UNION ALL
          SELECT level + 1, tree, sha256(string_agg(node, '' ORDER BY place)), place // {fan},
            (max(size) + {fan - 1}) // {fan}
          FROM {name} WHERE size > 1 GROUP BY level, tree, place // {fan})"""

    def fold(name: str, nodes: str, start: str) -> str:
        """Siblings and changed node of every row, level by level."""
        return f"""
        {name} AS (
          SELECT * FROM ({start})
          UNION ALL
          SELECT f.row_no, f.level + 1, f.tree, f.place // {fan},
            f.siblings || coalesce(string_agg(n.node, '' ORDER BY n.place)
              FILTER (n.place <> f.place), ''),
            sha256(string_agg(CASE WHEN n.place = f.place THEN f.changed ELSE n.node END, ''
              ORDER BY n.place))
          FROM {name} AS f JOIN {nodes} AS n
            ON n.tree = f.tree AND n.level = f.level AND n.place // {fan} = f.place // {fan}
          WHERE n.size > 1
          GROUP BY f.row_no, f.level, f.tree, f.place, f.siblings, f.changed)"""

    folds = fold("folds", "nodes", "SELECT row_no, 0 AS level, tree, place, '' AS siblings, "
                 "changed FROM leaves")
    tops = fold("tops", "roots", "SELECT f.row_no, 0 AS level, 0 AS tree, r.place, f.siblings, "
                "f.changed FROM folds AS f JOIN subroots AS r ON f.tree = r.name "
                "WHERE f.level = r.level")
    return f"""
        WITH RECURSIVE rows AS (
          SELECT row_number() OVER () AS row_no, doc_id, coalesce('=' || lang, '') AS tree,
            {leaf("text")} AS leaf,
            CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lowered)}
              ELSE {leaf("text")} END AS changed
          FROM documents),
        leaves AS (
          SELECT *, row_number() OVER (
              PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
            count(*) OVER (PARTITION BY tree) AS size
          FROM rows),
        {climb("nodes", "SELECT tree, leaf AS node, place, size FROM leaves")},
        subroots AS (
          SELECT tree AS name, level, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS place,
            count(*) OVER () AS size
          FROM nodes WHERE size = 1),
        {climb("roots", "SELECT 0 AS tree, node, place, size FROM subroots")},
        {folds},
        {tops},
        root AS (SELECT level, node FROM roots WHERE size = 1)
        SELECT doc_id, leaf, subroots.node AS subroot, root.node AS root,
          sha256(tops.siblings) AS proof_sha256, tops.changed AS folded_root,
          tops.changed = root.node AS verified
        FROM leaves JOIN tops USING (row_no) JOIN root ON root.level = tops.level
        JOIN subroots ON subroots.name = leaves.tree"""
