"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are integer (each component is floored after scaling). A block of vectors is
indexed by dimension: its rows in order of the component, cut into segments of about equal
value. A query weighs each segment by the largest product a row in it can add over the
least product of its dimension, its impact, and processes segments of all dimensions by
descending impact, adding the segment's quantised product to every row in it. What a row
may still gain is bounded by the impacts to come, so processing stops as soon as no row
outside the best k can reach them. Every row whose bound reaches the k-th best is a
possible member and is rescored with exact integers; ties go to the smaller id.

Query blocks meet vector blocks as rows of a join on the block number; a query keeps k rows
per block, which a window merges. No vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENTS = 8  # per dimension
BLOCK_CELLS = 1 << 19  # components in a block of vectors
QUERY_CELLS = 1 << 15
CHECK_EVERY = 64  # segments between two attempts at a proof
RESCORED = 32  # a proof that leaves this part of a block is enough
GROUP = 64  # queries that are processed together


class ImpactIndex:
    """Segments of one block of vectors, by dimension and component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, width = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        cuts = np.unique(np.linspace(0, n, min(SEGMENTS, n) + 1).astype(np.int64))
        self.begins, self.ends = cuts[:-1], cuts[1:]
        ordered = np.take_along_axis(vectors.T, self.order, axis=1)
        self.low = ordered[:, self.begins]  # least component of each segment
        self.high = ordered[:, self.ends - 1]

    def search(
        self, queries: np.ndarray, k: int, own: np.ndarray
    ) -> tuple[list[list[tuple[int, int]]], int]:
        """The best k (score, id) for each query, and how many segments were processed.

        The queries of a group share one order of segments, by the largest impact that any
        of them gives. `own` has the row that a query must not meet, or -1.
        """
        n, asked = len(self.ids), np.arange(len(queries))
        # Product bounds of a segment; a negative weight turns the ends around.
        weight = queries.T[:, None, :]
        ends = weight * self.low[:, :, None], weight * self.high[:, :, None]
        top, bottom = np.maximum(*ends), np.minimum(*ends)
        least = bottom.min(axis=1)
        gain, impact = bottom - least[:, None], top - least[:, None]
        # Still to gain, for a row that no segment of a dimension has covered yet; a row
        # that one has covered keeps the rounding open.
        ahead = impact.max(axis=1)
        settled = ahead[:, None] - (impact - gain)
        order = np.argsort(-impact.max(axis=2), axis=None, kind="stable")
        dims, parts = np.unravel_index(order, impact.shape[:2])
        sums = np.repeat(least.sum(axis=0)[None], n, axis=0)  # no row scores less than this
        left = np.repeat(ahead.sum(axis=0)[None], n, axis=0)
        lowest = np.iinfo(np.int64).min // 4
        mine = own >= 0
        sums[own[mine], asked[mine]] = lowest

        def possible() -> np.ndarray:
            at = max(0, n - k)
            floor = np.partition(sums, at, axis=0)[at]
            return (sums + left >= floor) & (sums > lowest // 2)

        done = 0
        for d, s in zip(dims.tolist(), parts.tolist(), strict=True):
            rows = self.order[d, self.begins[s]:self.ends[s]]
            sums[rows] += gain[d, s]
            left[rows] -= settled[d, s]
            done += 1
            if done % CHECK_EVERY == 0 and (
                possible().sum(axis=0).max() <= max(4 * k, n // RESCORED)
            ):
                break  # proof: every other row stays below the k-th best
        found = []
        members = possible()
        for q in asked.tolist():
            rows = np.flatnonzero(members[:, q])
            score = self.vectors[rows] @ queries[q]
            best = np.lexsort((self.ids[rows], -score))[:k]
            found.append(list(zip(score[best].tolist(), self.ids[rows][best].tolist(),
                                  strict=True)))
        return found, done


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as long integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _whole(vector: Column) -> Column:
    """Whether a vector exists and all its components are finite."""
    def finite(x: Column) -> Column:
        y = x.cast("double")
        return y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))

    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _blocked(rows: DataFrame, cells: int, prefix: str) -> DataFrame:
    """Rows (id, row_no, vector) packed into blocks of one width: width, ids, cells as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list, list]] = {}

        def packed(width: int) -> pa.RecordBatch:
            ids, numbers, vectors = waiting.pop(width)
            return pa.RecordBatch.from_arrays([
                pa.array([width], pa.int32()),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([np.array(numbers, np.int64).tobytes()], pa.binary()),
                pa.array([np.array(vectors, np.int64).tobytes()], pa.binary()),
            ], names=["width", f"{prefix}_ids", f"{prefix}_rows", f"{prefix}_cells"])

        for batch in batches:
            for id_, number, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, numbers, vectors = waiting.setdefault(len(vector), ([], [], []))
                ids.append(id_)
                numbers.append(number)
                vectors.append(vector)
                if (len(ids) + 1) * max(1, len(vector)) > cells:
                    yield packed(len(vector))
        for width in list(waiting):
            yield packed(width)

    return rows.mapInArrow(run, f"width int, {prefix}_ids binary, {prefix}_rows binary, "
                                f"{prefix}_cells binary")


def search(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k best rows of `vectors` for each row that satisfies `queries`, itself left out.

    Returns query_id, rank from 1, the id and the score. Vectors that are null or hold null
    or non-finite components take no part, neither do rows without an id; vectors of another
    width than the query's are not compared. A repeated id is a row of its own: each query
    row gets its own k results, and only the very same row is left out. Empty tables give
    no rows.
    """
    kept = vectors.filter(_whole(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row_no"),
        quantised(F.col(vector_col), scale).alias("vector"), queries.alias("asks"))
    # The grid of blocks: every query block goes to every group of vector blocks, once.
    groups = max(1, vectors.sparkSession.sparkContext.defaultParallelism * 2)
    stored_blocks = _blocked(kept.drop("asks"), BLOCK_CELLS, "v").withColumn(
        "part", F.pmod(F.xxhash64("v_rows"), F.lit(groups)).cast("int"))
    query_blocks = _blocked(kept.filter("asks").drop("asks"), QUERY_CELLS, "q").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = stored_blocks.join(query_blocks, ["part", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(batch.column(names.index(n)).to_pylist() for n in (
                    "width", "v_ids", "v_rows", "v_cells", "q_ids", "q_rows", "q_cells")),
                    strict=True):
                width, (v_ids, v_rows, q_ids, q_rows) = row[0], (
                    np.frombuffer(row[i], np.int64) for i in (1, 2, 4, 5))
                if last != row[2]:
                    last = row[2]
                    cells = np.frombuffer(row[3], np.int64).reshape(len(v_ids), width)
                    index = ImpactIndex(v_ids, cells)
                asked = np.frombuffer(row[6], np.int64).reshape(len(q_ids), width)
                out: list[tuple] = []
                place = {number: i for i, number in enumerate(v_rows.tolist())}
                own = np.array([place.get(r, -1) for r in q_rows.tolist()], np.int64)
                for cut in range(0, len(asked), GROUP):
                    to = slice(cut, cut + GROUP)
                    best, _ = index.search(asked[to], k, own[to])
                    out.extend(
                        (q, number, id_, score)
                        for q, number, scored in zip(
                            q_ids[to].tolist(), q_rows[to].tolist(), best, strict=True)
                        for score, id_ in scored)
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["query_id", "row_no", "id", "score"])

    found = met.mapInArrow(run, "query_id bigint, row_no bigint, id bigint, score bigint")
    order = Window.partitionBy("row_no").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
