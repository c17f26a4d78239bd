"""The catalog: append-only Parquet tables in numbered batches, with a log of commits.

A change of the catalog is one batch: the rows it adds to each table, and the documents
whose older rows it replaces. Nothing stored is rewritten, so what a change writes grows
with the change. Its commit is one row of the log, written last: readers see all tables of
a batch or none of them, and a run that died leaves nothing visible.

Reading merges: a row counts unless a later batch replaced its document. Statistics are
sums, so a batch adds what its postings add and takes off what it replaced. Compaction
merges the latest batches into one as soon as they weigh enough against the batch before
them, so a row is rewritten a logarithmic number of times, and a large base stays where
it is. Files that no live batch holds stay for plans and versions that read them, until
`vacuum`.

Inside a batch, rows are partitioned by a hash of the document id. All tables of a document
share its part, including the postings, and a frequent term is spread over all parts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan import schemas
from folioscan.functions import keys
from folioscan.operators import joins, upserts
from folioscan.sources.shared import discard, small_reads

DEFAULT_PARTS = 16
# Compaction merges batches whose rows are at least this share of the batch before them.
MERGED_SHARE = 0.25
# A commit compacts by itself beyond so many live batches.
MOST_BATCHES = 32

# Tables that others are made of, task by task: a task reads so much of them, so that what
# it makes is sorted in memory. Row groups are small enough for that.
PLACED_BYTES = 16 << 20
READ_BY_TASK = {"chunks", "postings"}

# Files of a part are sorted, so that a lookup skips row groups by their statistics.
SORTED_BY = {
    "documents": ["doc_id"],
    "chunks": ["doc_id", "ordinal"],
    "chunk_embeddings": ["doc_id", "chunk_id"],
    "doc_metadata": ["doc_id", "key"],
    "tags": ["doc_id", "tag"],
    "postings": ["term", "chunk_id"],
    "term_stats": ["term"],
    "corpus_stats": [],
}
# Tables of partial sums: what they are summed by. They have no documents.
SUMMED_BY = {"term_stats": ["term"], "corpus_stats": []}

_LONG = T.LongType()
COMMITS = T.StructType([
    T.StructField("batch", _LONG),
    # Tables of the batch with their rows, and batches whose rows it holds now.
    T.StructField("rows", T.MapType(T.StringType(), _LONG)),
    T.StructField("merges", T.ArrayType(_LONG)),
    T.StructField("replaced", _LONG),
])
REPLACED = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("tables", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class Commit:
    """One committed batch."""

    batch: int
    rows: dict[str, int]
    merges: list[int]
    replaced: int

    @property
    def weight(self) -> int:
        return sum(self.rows.values())


def _term_counts(postings: DataFrame) -> DataFrame:
    """(part, term, df) as partial sums: stored postings are sorted, so equal terms adjoin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, term = batch.column("part"), batch.column("term")
            codes = [x.dictionary_encode(null_encoding="encode").indices.to_numpy()
                     for x in (part, term)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([
                part.take(pa.array(at)), term.take(pa.array(at)),
                pa.array(np.diff(np.r_[at, batch.num_rows]).astype(np.int64))],
                names=["part", "term", "df"])

    return postings.select("part", "term").mapInArrow(run, "part int, term string, df bigint")


class Change:
    """The rows that one batch adds, and the documents it replaces; committed on exit.

        with catalog.change() as change:
            change.replace("chunks", chunks, touched)
            change.replace("tags", tags, touched)
    """

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.batch = catalog.last_batch() + 1
        self.tables: list[str] = []
        self.gone: dict[str, DataFrame] = {}
        self._known: dict[int, DataFrame] = {}

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.catalog.commit(self)

    def replace(
        self, name: str, new: DataFrame, touched: DataFrame, gone: DataFrame | None = None,
        placed: bool = False,
    ) -> None:
        """Replace all rows of the touched documents in one table.

        `gone` are the touched documents that have rows, where the caller knows them.
        """
        self.append(name, new, placed)
        if self.catalog.live(name):
            self.gone[name] = touched.select("doc_id").distinct().join(
                self.catalog.table(name).select("doc_id"), "doc_id", "left_semi"
            ) if gone is None else gone.select("doc_id")

    def append(self, name: str, rows: DataFrame, placed: bool = False) -> None:
        """Add rows to a table; statistics need their `part`.

        `placed` rows are made of stored rows, task by task.
        """
        if name not in SUMMED_BY:
            rows = rows.withColumn("part", keys.part_of(F.col("doc_id"), self.catalog.parts))
        self.catalog.write_batch(
            name, rows.withColumn("added", F.lit(self.batch)), self.batch, placed)
        self.tables.append(name)

    def rows(self, name: str) -> DataFrame:
        """What this change adds to a table."""
        return self.catalog.batches(name, [self.batch]).select(
            *schemas.DOCUMENT_TABLES[name].names, "part")


class Catalog:
    """Tables of one catalog below `root`, a path all executors can reach."""

    def __init__(self, spark: SparkSession, root: str, parts: int = DEFAULT_PARTS):
        self.spark, self.root = spark, root.rstrip("/")
        self._until = {}
        for name, schema in (("catalog_meta", self._meta_schema()), ("commits", COMMITS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))
        stored = self.setting("parts")
        if stored is None:
            self.set_setting("parts", str(parts))
        self.parts = parts if stored is None else int(stored)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @staticmethod
    def _meta_schema() -> T.StructType:
        return T.StructType([*schemas.CATALOG_META, T.StructField("seq", _LONG)])

    @staticmethod
    def _stored_schema(name: str) -> T.StructType:
        return T.StructType([
            *schemas.DOCUMENT_TABLES[name], T.StructField("added", _LONG),
            T.StructField("part", T.IntegerType()), T.StructField("batch", _LONG),
        ])

    # -- the log ---------------------------------------------------------------

    def log(self, version: int | None = None) -> list[Commit]:
        """Commits in order, up to a version; one small row per change."""
        rows = self.spark.read.schema(COMMITS).parquet(self.path("commits")).collect()
        return sorted(
            (Commit(r.batch, dict(r.rows), list(r.merges), r.replaced) for r in rows
             if version is None or r.batch <= version),
            key=lambda c: c.batch)

    def last_batch(self) -> int:
        """The version of the catalog; 0 before the first change."""
        return max((c.batch for c in self.log()), default=0)

    def live(self, name: str | None = None, version: int | None = None) -> list[Commit]:
        """Commits whose rows no later commit has merged, of one table or of all."""
        log = self.log(version)
        merged = {b for c in log for b in c.merges}
        return [c for c in log if c.batch not in merged and (name is None or name in c.rows)]

    # -- reading ---------------------------------------------------------------

    def batches(self, name: str, numbers: list[int]) -> DataFrame:
        """All rows that some batches hold of a table, replaced ones too."""
        schema = self._stored_schema(name)
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(
            *[f"{self.path(name)}/batch={n}" for n in numbers])

    def replaced(self, name: str, after: int, version: int | None = None) -> DataFrame | None:
        """(doc_id, batch) of the documents whose rows were replaced in later batches.

        None where there is none. Documents appear once per batch that replaced them.
        """
        found = self._replacing(after, version)
        return self._replaced(name, found) if found else None

    def _replacing(self, after: int, version: int | None) -> list[Commit]:
        return [c for c in self.log(version) if c.replaced and c.batch > after]

    def _replaced(self, name: str, found: list[Commit]) -> DataFrame:
        schema = T.StructType([*REPLACED, T.StructField("batch", _LONG)])
        rows = self.spark.read.schema(schema).option("basePath", self.path("replaced")).parquet(
            *[f"{self.path('replaced')}/batch={c.batch}" for c in found])
        return rows.filter(F.array_contains("tables", name)).select("doc_id", "batch")

    def stored(
        self, name: str, version: int | None = None, after: int = 0,
        only: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """The rows of a table with their part and batch; those added after a batch.

        Files of batches up to `after` are not opened. `only` keeps rows of its choice,
        before replaced ones are looked up.
        """
        commits = [c.batch for c in self.live(name, version)]
        rows = self.batches(name, [b for b in commits if b > after]).filter(F.col("added") > after)
        return self._surviving(
            name, only(rows) if only else rows, min(commits, default=0), version, bool(only))

    def _surviving(
        self, name: str, rows: DataFrame, first: int, version: int | None = None,
        last: bool = False,
    ) -> DataFrame:
        found = [] if name in SUMMED_BY else self._replacing(first, version)
        if not found:
            return rows
        gone = self._replaced(name, found)
        until = gone.groupBy("doc_id").agg(F.max("batch").alias("_until"))
        small, held = self._known_until(name, gone, found)
        if held is not None:
            return rows.filter(F.col("batch") >= held(last))
        return rows.join(F.broadcast(until) if small else until, "doc_id", "left").filter(
            F.col("_until").isNull() | (F.col("batch") >= F.col("_until"))
        ).select(*self._stored_schema(name).names)

    def _known_until(
        self, name: str, gone: DataFrame, found: list[Commit]
    ) -> tuple[bool, Callable[[bool], Column] | None]:
        """Whether replaced documents may be broadcast; if not, their `held_numbers`, if few."""
        # Committed batches stay as they are; only the latest set of a table is kept.
        batches = [c.batch for c in found]
        if name not in self._until or self._until[name][0] != batches:
            small = joins.is_small(gone.select("doc_id"))
            few = sum(c.replaced for c in found) <= joins.HELD_KEYS
            self._until[name] = batches, small, joins.held_numbers(
                gone, "doc_id", F.col("batch")) if few and not small else None
        return self._until[name][1:]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table in its fixed schema, as of a version (default: the last one)."""
        schema = schemas.DOCUMENT_TABLES[name]
        if name not in SUMMED_BY:
            return self.stored(name, version).select(*schema.names)
        by = SUMMED_BY[name]
        values = [f for f in schema.names if f not in by]
        total = self.stored(name, version).groupBy(*by).agg(
            *(F.sum(v).alias(v) for v in values))
        return total.filter(F.col(values[0]) > 0).select(*schema.names)

    def changes(self, name: str, after: int) -> DataFrame:
        """Rows added after a version and not replaced since: a feed of what is new."""
        return self.stored(name, after=after).select(*schemas.DOCUMENT_TABLES[name].names)

    # -- settings --------------------------------------------------------------

    def setting(self, key: str) -> str | None:
        """Value of a setting, None when it was never set."""
        rows = self.spark.read.schema(self._meta_schema()).parquet(self.path("catalog_meta"))
        return rows.filter(F.col("key") == key).agg(F.max_by("value", "seq")).first()[0]

    def set_setting(self, key: str, value: str) -> None:
        """Set a value; the last one counts."""
        row = self.spark.createDataFrame(
            [(key, value, time.time_ns())], self._meta_schema()
        )
        row.coalesce(1).write.mode("append").parquet(self.path("catalog_meta"))

    def lock(self, key: str, requested: str) -> str:
        """The value of `key`, which becomes `requested` when it has none yet."""
        value = self.setting(key)
        if value is None:
            self.set_setting(key, requested)
            return requested
        return value

    # -- writing ---------------------------------------------------------------

    def change(self) -> Change:
        """A new batch; everything it writes becomes visible at once."""
        return Change(self)

    def replace(self, name: str, new: DataFrame, touched: DataFrame) -> None:
        """Replace all rows of the touched documents in one table: a change of its own."""
        with self.change() as change:
            change.replace(name, new, touched)

    def write_batch(
        self, name: str, rows: DataFrame, batch: int, placed: bool = False
    ) -> None:
        """Write one table of a batch; what a dead run left there is overwritten.

        The rebalance splits a part that is much larger than others over several files.
        `placed` rows follow the files of a table written so and are not moved again.
        """
        columns = [f for f in self._stored_schema(name).names if f != "batch"]
        rows = rows.select(*columns)
        writer = (
            (rows if placed else rows.hint("rebalance", F.col("part")))
            .sortWithinPartitions("part", *SORTED_BY[name])
            .write.mode("overwrite").partitionBy("part")
        )
        if name in READ_BY_TASK:
            writer = writer.option("parquet.block.size", PLACED_BYTES)
        with small_reads(self.spark, PLACED_BYTES) if placed else nullcontext():
            writer.parquet(f"{self.path(name)}/batch={batch}")

    def commit(self, change: Change, merges: list[int] | None = None) -> None:
        """Make a batch visible, and compact where too many have come together."""
        replaced = 0
        if change.gone:
            named = [g.withColumn("name", F.lit(name)) for name, g in change.gone.items()]
            rows = named[0]
            for more in named[1:]:
                rows = rows.unionByName(more)
            path = f"{self.path('replaced')}/batch={change.batch}"
            rows.groupBy("doc_id").agg(F.collect_set("name").alias("tables")).write.mode(
                "overwrite").parquet(path)
            replaced = self.spark.read.schema(REPLACED).parquet(path).count()
        counts = {name: self.batches(name, [change.batch]).count() for name in change.tables}
        row = self.spark.createDataFrame(
            [(change.batch, counts, merges or [], replaced)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(self.path("commits"))
        if merges is None and len(self.live()) > MOST_BATCHES:
            self.compact()

    def refresh_statistics(self, change: Change) -> None:
        """Add to a change what its postings and chunks add to the sums, and take off.

        Only the parts of replaced documents are read from earlier batches. Postings are
        counted in the task that reads them; where nothing is taken off, these sums stay.
        """
        def taken_off(name: str) -> DataFrame | None:
            gone = change.gone.get(name)
            if gone is None:
                return None
            parts = [r[0] for r in gone.select(
                keys.part_of(F.col("doc_id"), self.parts).alias("p")).distinct().collect()]
            return joins.with_key(
                self.stored(name).filter(F.col("part").isin(*parts)), gone, "doc_id")

        def signed(new: DataFrame, old: DataFrame | None) -> DataFrame:
            new = new.withColumn("sign", F.lit(1))
            return new if old is None else new.unionByName(
                old.select(*new.columns[:-1]).withColumn("sign", F.lit(-1)))

        new, old = change.rows("postings"), taken_off("postings")
        terms = _term_counts(new)
        if old is not None:
            terms = signed(terms, _term_counts(old)).groupBy("part", "term").agg(
                F.sum(F.col("sign") * F.col("df")).cast("bigint").alias("df")).filter("df <> 0")
        change.append("term_stats", terms, placed=old is None)
        postings, chunks = signed(new, old), signed(change.rows("chunks"), taken_off("chunks"))
        length = F.sum(F.col("sign") * F.col("tf")).cast("bigint").alias("total_len")
        totals = chunks.groupBy("part").agg(F.sum("sign").cast("bigint").alias("n_chunks")).join(
            postings.groupBy("part").agg(length), "part", "full")
        change.append("corpus_stats", totals.select(
            "part", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            F.coalesce("total_len", F.lit(0)).alias("total_len")))

    def compact(self, everything: bool = False) -> list[int]:
        """Merge the latest live batches into one and return their numbers.

        Goes back as long as the batches so far weigh at least MERGED_SHARE of the one
        before, or to the first one. Rows keep the batch that added them.
        """
        live = self.live()
        chosen, weight = [], 0
        for commit in reversed(live):
            if chosen and not everything and weight < MERGED_SHARE * commit.weight:
                break
            chosen.append(commit)
            weight += commit.weight
        if len(chosen) < 2:
            return []
        merged = sorted(c.batch for c in chosen)
        change = self.change()
        for name in sorted({n for c in chosen for n in c.rows}):
            rows = self.batches(name, [c.batch for c in chosen if name in c.rows])
            if name in SUMMED_BY:
                by = ["part", *SUMMED_BY[name]]
                values = [f for f in schemas.DOCUMENT_TABLES[name].names if f not in by]
                rows = rows.groupBy(*by).agg(
                    *(F.sum(v).alias(v) for v in values), F.max("added").alias("added"))
            else:
                rows = self._surviving(name, rows, merged[0])
            self.write_batch(name, rows, change.batch)
            change.tables.append(name)
        self.commit(change, merged)
        return merged

    def vacuum(self) -> list[int]:
        """Delete the files of merged batches; versions before the merge end with them."""
        kept = {c.batch for c in self.live()}
        dead = [c for c in self.log() if c.batch not in kept]
        for commit in dead:
            for name in commit.rows:
                discard(self.spark, f"{self.path(name)}/batch={commit.batch}")
        return [c.batch for c in dead]

    def drop_legacy_columns(self) -> bool:
        """Take over tables of the layout without batches; returns whether there were any.

        The vector column that early chunk tables had is left out, rows that only marked
        an emptied part too.
        """
        found = {}
        for name in schemas.DOCUMENT_TABLES:
            try:
                old = self.spark.read.option("basePath", self.path(name)).parquet(
                    f"{self.path(name)}/part=*")
            except AnalysisException:  # no such folder
                continue
            key = schemas.DOCUMENT_TABLES[name].names[0]
            found[name] = upserts.drop_legacy_columns(old).filter(F.col(key).isNotNull())
        if not found:
            return False
        with self.change() as change:
            for name, rows in found.items():
                change.append(name, rows)
        for name in found:
            discard(self.spark, f"{self.path(name)}/part=*")
        return True
