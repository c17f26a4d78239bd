"""Product codes of vectors: exact integer k-means per part, pruned with LAESA pivots.

A vector of integers is cut into `PARTS` consecutive parts; every part position has a codebook
whose entries start as the parts of the first vectors. Each round assigns all parts to their
nearest entry and moves the entries to the floored means.

Distances of every part to a few fixed pivots are computed once and kept with the vectors. In
a round only the distances of the entries to the pivots are new: the largest difference
|d(part, pivot) - d(entry, pivot)| is a lower bound of d(part, entry). Entries are taken in the
order of their bounds, and a part is done as soon as the next bound exceeds its best distance;
what is evaluated is evaluated in exact integers, and a tie falls to the lower index.

On Spark a round is one pass over the stored vectors; tasks return sums per entry, whose
number does not depend on the rows. The codebooks (entries times width) are all that the
driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import stored
from folioscan.operators.joins import is_small, join_small

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
PIVOTS = 4
LARGEST = 1 << 24  # components beyond are held there, so that distances stay 64-bit integers
BATCH_CELLS = 1 << 20
# Pivot distances are kept as 32-bit floats; bounds give way by more than their rounding.
ROUNDING = 1e-6


def cuts(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Begin and end of each part; as equal as the width allows."""
    edges = [i * width // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer points, one for one."""
    gap = rows - points
    return np.einsum("ij,ij->i", gap, gap)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of every row to every point."""
    return np.sqrt(np.stack(
        [squared(rows, p).astype(np.float64) for p in points], axis=1).reshape(len(rows), -1))


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far apart: each next one has the largest least distance to those before."""
    chosen = [0]
    least = squared(entries, entries[0])
    while len(chosen) < min(count, len(entries)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest(
    rows: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry, and how many were evaluated."""
    n = len(rows)
    of_entries = distances(entries, pivots)
    bound = np.zeros((n, len(entries)))
    for p in range(len(pivots)):
        mine, theirs = to_pivots[:, p:p + 1].astype(np.float64), of_entries[None, :, p]
        np.maximum(bound, np.abs(mine - theirs) - ROUNDING * (mine + theirs), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.zeros(n, np.int64)
    left, evaluated = np.arange(n), 0
    for rank in range(len(entries)):
        entry = order[left, rank]
        # The bounds to come are no smaller, so a row whose next one is too large is done.
        low = bound[left, entry]
        open_rows = low * low * (1 - ROUNDING) <= best[left]
        left, entry = left[open_rows], entry[open_rows]
        if not len(left):
            break
        evaluated += len(left)
        found = squared(rows[left], entries[entry])
        closer = (found < best[left]) | ((found == best[left]) & (entry < index[left]))
        best[left[closer]], index[left[closer]] = found[closer], entry[closer]
    return index, best, evaluated


def _whole(vector: Column) -> Column:
    """Whether a vector exists and all its components are finite numbers."""
    def finite(x: Column) -> Column:
        y = x.cast("double")
        return y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))

    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as integers within +-LARGEST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), x.cast("double") * scale))).cast("int"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BATCH_CELLS // max(1, width))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Codebooks:
    """The entries and fixed pivots of every part position."""

    def __init__(self, first: np.ndarray, parts: int = PARTS, pivots: int = PIVOTS):
        self.width = first.shape[1]
        self.cuts = cuts(self.width, parts)
        self.entries = [first[:, a:b].copy() for a, b in self.cuts]
        self.pivots = [choose_pivots(e, pivots) for e in self.entries]

    def pivot_distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [distances(vectors[:, a:b], p).astype(np.float32)
                for (a, b), p in zip(self.cuts, self.pivots, strict=True)]

    def assign(
        self, vectors: np.ndarray, to_pivots: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry index and squared distance per row and part; entries evaluated."""
        codes, errors, evaluated, at = [], [], 0, 0
        for (a, b), entries, pivots in zip(self.cuts, self.entries, self.pivots, strict=True):
            index, error, count = nearest(
                vectors[:, a:b], to_pivots[:, at:at + len(pivots)], entries, pivots)
            codes.append(index)
            errors.append(error)
            evaluated += count
            at += len(pivots)
        return np.stack(codes, axis=1), np.stack(errors, axis=1), evaluated

    def moved(self, totals: dict[tuple[int, int], tuple[int, list[int]]]) -> None:
        """Replace entries by floored means: (part, entry) to count and component sums."""
        for (part, entry), (count, sums) in totals.items():
            self.entries[part][entry] = [s // count for s in sums]

    def digest(self) -> str:
        numbers = (str(x) for e in self.entries for x in e.ravel().tolist())
        return sha256(",".join(numbers).encode()).hexdigest()


def _totals(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of the parts nearest to each used entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        counts = np.zeros((len(sums), len(books.entries[0])), np.int64)
        for piece in _pieces(batches, books.width):
            rows = _matrix(piece.column("vector"), books.width)
            codes, _, _ = books.assign(rows, _near(piece, len(rows)))
            for part, (a, b) in enumerate(books.cuts):
                np.add.at(sums[part], codes[:, part], rows[:, a:b])
                counts[part] += np.bincount(codes[:, part], minlength=counts.shape[1])
        for part, total in enumerate(sums):
            used = np.flatnonzero(counts[part])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), part), pa.int32()), pa.array(used, pa.int32()),
                pa.array(counts[part][used]), pa.array(total[used].tolist(), pa.list_(pa.int64())),
            ], names=["part", "entry", "held", "sums"])

    partial = vectors.mapInArrow(run, "part int, entry int, held bigint, sums array<bigint>")
    width = max(b - a for a, b in books.cuts)
    summed = partial.groupBy("part", "entry").agg(
        F.sum("held").alias("held"),
        F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
    # At most PARTS * ENTRIES rows, however many vectors there are.
    return {(r.part, r.entry): (r.held, [s for s in r.sums if s is not None])
            for r in summed.collect()}


def _near(piece: pa.RecordBatch, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(piece.column("near").to_pylist()), np.float32).reshape(rows, -1)


def encode(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    extra: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> tuple[DataFrame, Codebooks | None]:
    """Per vector: id, the columns of `extra`, codes (array<int>) and error; and the codebooks.

    Vectors that are null, hold a null or non-finite component, or differ in width from that
    of the smallest id are left out. Codebooks start from the vectors of the smallest ids,
    nulls last; rows of one id stand in the order of their components, and equal rows may
    both be entries. Fewer vectors than entries give smaller codebooks; no vectors give
    no rows and no codebooks. Widths that the number of parts does not divide give parts that
    differ by one component. Components are held within +-2^24 after scaling. Only the
    named columns are read.
    """
    def column(name: str) -> Column:
        return F.col(f"`{name}`")

    spark = embeddings.sparkSession
    whole = embeddings.select(
        column(id_col).alias("id"), F.struct(
            F.lit(0).alias("_"), *(column(c).alias(f"c{i}") for i, c in enumerate(extra))
        ).alias("kept"),
        F.when(_whole(column(vector_col)), quantised(column(vector_col))).alias("vector"),
    ).filter("vector IS NOT NULL")
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    lead = whole.orderBy(*order).limit(1).select(F.size("vector")).first()
    names = [F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(extra)]
    if lead is None:
        return spark.createDataFrame([], whole.select(
            F.col("id").alias(id_col), *names, F.array(F.lit(0)).alias("codes"),
            F.lit(0).cast("bigint").alias("error")).schema), None
    whole = whole.filter(F.size("vector") == lead[0])
    first = whole.orderBy(*order).limit(entries).select("vector").collect()
    books = Codebooks(np.array([r.vector for r in first], np.int64).reshape(len(first), -1),
                      parts, pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, books.width):
            near = np.concatenate(books.pivot_distances(
                _matrix(piece.column("vector"), books.width)), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array([row.tobytes() for row in near], pa.binary())],
                names=[*piece.schema.names, "near"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    vectors = stored(whole.mapInArrow(measured, f"{schema}, near binary"), "code-vectors")
    for _ in range(rounds):
        books.moved(_totals(vectors, books))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, books.width):
            rows = _matrix(piece.column("vector"), books.width)
            codes, errors, _ = books.assign(rows, _near(piece, len(rows)))
            yield pa.RecordBatch.from_arrays([
                piece.column("id"), piece.column("kept"),
                pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32())),
                pa.array(errors.sum(axis=1)),
            ], names=["id", "kept", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    found = vectors.mapInArrow(
        coded, f"id {kinds['id']}, kept {kinds['kept']}, codes array<int>, error bigint")
    return found.select(F.col("id").alias(id_col), *names, "codes", "error"), books


def report(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Codes in hex with errors per vector and per label, and the codebooks' digest.

    Rows as `encode` gives them; null labels count as one label.
    """
    found, books = encode(embeddings, id_col, vector_col, extra=(label_col,))
    found = found.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.array_join(
            F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
        "error")
    if books is not None:
        found = stored(found, "codes")
    keyed = found.withColumn("unlabelled", F.col("label").isNull()).withColumn(
        "same", F.coalesce(F.col("label").cast("string"), F.lit("")))
    total = keyed.groupBy("unlabelled", "same").agg(F.sum("error").alias("label_error"))
    return join_small(
        keyed, total, ["unlabelled", "same"], F.col("code"), is_small(total)
    ).select(
        F.col("id").alias(id_col), "code", "error", "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The SQL of the contract's query, for vectors of one width that `parts` divides."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} AS MATERIALIZED (
          SELECT row_no, part, entry, distance FROM (
            SELECT p.row_no, p.part, b.entry,
              list_sum(list_transform(list_zip(p.piece, b.piece),
                lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance,
              row_number() OVER (PARTITION BY p.row_no, p.part ORDER BY distance, b.entry) AS n
            FROM pieces AS p JOIN book{r} AS b USING (part)) WHERE n = 1)""")
        if r < rounds:
            steps.append(f"""
        mean{r} AS (
          SELECT part, entry, list(CAST(floor(total / held) AS BIGINT) ORDER BY i) AS piece FROM (
            SELECT n.part, n.entry, i, sum(p.piece[i]) AS total, count(*) AS held
            FROM near{r} AS n JOIN pieces AS p USING (row_no, part),
              (SELECT unnest(range(1, 1 + (SELECT max(len(piece)) FROM pieces))) AS i)
            GROUP BY n.part, n.entry, i) GROUP BY part, entry),
        book{r + 1} AS MATERIALIZED (
          SELECT part, entry, coalesce(m.piece, b.piece) AS piece
          FROM book{r} AS b LEFT JOIN mean{r} AS m USING (part, entry))""")
    return f"""
        WITH kept AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding,
              lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v,
            row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS row_no
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pieces AS MATERIALIZED (
          SELECT row_no, part, v[1 + part * len(v) // {parts} : (part + 1) * len(v) // {parts}]
            AS piece
          FROM kept, (SELECT unnest(range({parts})) AS part)),
        book0 AS (SELECT part, row_no AS entry, piece FROM pieces WHERE row_no < {entries}),
        {",".join(steps)},
        digest AS (
          SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) AS hex
          FROM book{rounds}),
        coded AS (
          SELECT row_no, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
            CAST(sum(distance) AS BIGINT) AS error
          FROM near{rounds} GROUP BY row_no)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT)
          AS label_error, hex AS codebooks_sha256
        FROM kept JOIN coded USING (row_no), digest"""
