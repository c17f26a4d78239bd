"""Records of huge delimited and JSON files, cut by many tasks.

Spark reads a file in splits of lines (or of pieces between commas, for JSON, which may have
no lines). Whether a line break or a comma ends a record depends on all that comes before it:
an open quote, the depth of brackets. So the first pass reduces every split to a transition
function, from the state on entry to the state at its end, for both possible quote states.
Composed in the order of the splits, one row each, these give every split its true state. The
second pass cuts all splits at once. What a split holds before its first and after its last
boundary are fragments; those of one record meet by a shuffle of nothing but fragments.

A record must fit into a row; a file need not. Both passes read the same splits; should
Spark plan them otherwise the second time, the job fails and says so.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators.joins import is_small, join_small
from folioscan.sources.shared import kept_once

# Text that is parsed and returned at a time.
FLUSH_BYTES = 1 << 20
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Delimited:
    """Delimited text: a record ends at a line break outside quotes."""

    delimiter: str = ","
    separator = "\n"
    value_type = "array<string>"

    def scan(self, piece: bytes, inside: bool) -> tuple[bool, int]:
        """Whether a line ends inside quotes, given whether it begins there.

        A quote opens a field only at its start; after the closing one the rest of the
        field is taken as it is.
        """
        if b'"' not in piece:
            return inside, 0
        stop = re.compile(re.escape(self.delimiter.encode()) + rb"|\r")
        at = 0
        if not inside and piece[:1] == b'"':
            inside, at = True, 1
        while True:
            if inside:
                at = piece.find(b'"', at)
                if at < 0:
                    return True, 0
                if piece[at + 1:at + 2] == b'"':
                    at += 2
                    continue
                inside, at = False, at + 1
            found = stop.search(piece, at)
            if not found:
                return False, 0
            at = found.end()
            if piece[at:at + 1] == b'"':
                inside, at = True, at + 1

    def is_boundary(self, inside: bool, depth: int, array: bool) -> bool:
        return not inside

    def records(self, text: bytes, latin: bool, first: bool, last: bool) -> list:
        """Rows of cells of whole records; lines without a cell are no rows."""
        if first and not latin:
            text = text.removeprefix(_BOM)
        read = text.decode("cp1252" if latin else "utf-8", errors="replace")
        csv.field_size_limit(sys.maxsize)
        lines = csv.reader(io.StringIO(read, newline=""), delimiter=self.delimiter)
        return [row for row in lines if row]

    def joins(self) -> bool:
        """Whether several records may be given to `records` at once."""
        return True

    def needs_end(self, array: bool) -> bool:
        """Whether a file that ends at a boundary is cut off."""
        return False


@dataclass(frozen=True)
class JsonArray:
    """One JSON array: an element ends at a comma outside strings at depth one.

    A file that is no array is one record.
    """

    separator = ","
    value_type = "string"

    def scan(self, piece: bytes, inside: bool) -> tuple[bool, int]:
        """Whether a piece ends inside a string, and how much deeper than it began."""
        if b'"' in piece:
            if b"\\" in piece:
                piece = _ESCAPED.sub(b"", piece)
            parts = piece.split(b'"')
            piece = b"".join(parts[inside::2])
            inside = bool((inside + len(parts) - 1) % 2)
        elif inside:
            return True, 0
        return inside, (piece.count(b"[") + piece.count(b"{")
                        - piece.count(b"]") - piece.count(b"}"))

    def is_boundary(self, inside: bool, depth: int, array: bool) -> bool:
        return array and not inside and depth == 1

    def records(self, text: bytes, latin: bool, first: bool, last: bool) -> list:
        """The element, without the brackets of the array; None where they are missing."""
        read = (text.removeprefix(_BOM) if first else text).decode(errors="replace").strip()
        if first and not read.startswith("["):
            return [read]
        read = read[1:] if first else read
        if not last:
            return [read]
        if not read.endswith("]"):
            return [None]
        return [] if first and not read[:-1].strip() else [read[:-1]]

    def joins(self) -> bool:
        return False

    def needs_end(self, array: bool) -> bool:
        return array


Format = Delimited | JsonArray
_SUMMARY = ("path string, start bigint, end_out boolean, end_in boolean, deeper_out bigint, "
            "deeper_in bigint, bytes bigint, file_bytes bigint, valid boolean, head binary")
_STATES = ("path string, start bigint, inside boolean, depth bigint, latin boolean, "
           "array boolean, fresh boolean, first boolean, last boolean, trailing boolean")


def _pieces(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(path, start, piece) of all files, in order inside every split."""
    return spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(
        paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("file_bytes"), F.col("value").cast("binary").alias(
            "piece"))


def _decoded(path: str) -> Column:
    """The path as listings name it; the scan gives it encoded like a URI."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    return list(zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True))


def _summaries(pieces: DataFrame, form: Format) -> DataFrame:
    """A row per split: where both entry states lead, its size and encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, None
        for batch in batches:
            paths = batch.column("path").to_numpy(zero_copy_only=False)
            starts = batch.column("start").to_numpy()
            for begin, end in _runs([paths, starts]) if batch.num_rows else []:
                part = batch.slice(begin, end - begin)
                if (paths[begin], starts[begin]) != key:
                    if row:
                        yield finished(key, row)
                    key = paths[begin], starts[begin]
                    row = {"out": (False, 0), "in": (True, 0), "bytes": 0, "valid": True,
                           "file": part.column("file_bytes")[0].as_py(), "head": b""}
                values = part.column("piece").to_pylist()
                for entry in ("out", "in"):
                    inside, depth = row[entry]
                    for value in values:
                        inside, deeper = form.scan(value, inside)
                        depth += deeper
                    row[entry] = inside, depth
                row["bytes"] += sum(map(len, values)) + len(values)
                row["valid"] &= valid(part.column("piece"))
                if len(row["head"]) < 16:
                    row["head"] += b"".join(values).removeprefix(_BOM).lstrip()[:16]
        if row:
            yield finished(key, row)

    def valid(column: pa.Array) -> bool:
        try:
            column.cast(pa.string())
        except pa.ArrowInvalid:
            return False
        return True

    def finished(key: tuple, row: dict) -> pa.RecordBatch:
        values = [key[0], key[1], row["out"][0], row["in"][0], row["out"][1], row["in"][1],
                  row["bytes"], row["file"], row["valid"], row["head"]]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.bool_(),
                 pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
            names=[c.split()[0] for c in _SUMMARY.split(", ")])

    return pieces.mapInArrow(run, _SUMMARY)


def _entry_states(summaries: DataFrame, form: Format) -> DataFrame:
    """The state on entry of each split; a file's group has one row per split."""

    def compose(splits: pd.DataFrame) -> pd.DataFrame:
        splits = splits.sort_values("start", ignore_index=True)
        head = next((bytes(h) for h in splits["head"] if h), b"")
        array, latin = head[:1] == b"[", not splits["valid"].all()
        inside, depth, rows = False, 0, []
        for n, s in enumerate(splits.itertuples()):
            fresh = n == 0 or form.is_boundary(inside, depth, array)
            rows.append((s.path, s.start, inside, depth, latin, array, fresh, n == 0,
                         n == len(splits) - 1, splits["bytes"].sum() == s.file_bytes))
            inside, depth = ((s.end_in, depth + s.deeper_in) if inside
                             else (s.end_out, depth + s.deeper_out))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _STATES.split(", ")])

    return kept_once(summaries.groupBy("path").applyInPandas(compose, _STATES).withColumn(
        "split", F.monotonically_increasing_id()).withColumn("local_path", _decoded("path")))


def _cut(pieces: DataFrame, states: DataFrame, form: Format) -> DataFrame:
    """Records (split, at, value) of all splits, and fragments.

    Of a fragment, `at` counts the records of its split before it, `opens` says that its
    record begins there and `to_end` that it reaches the end of the split.
    """
    entry = ["split", "inside", "depth", "latin", "array", "fresh", "first", "last"]
    schema = (f"split bigint, at bigint, value {form.value_type}, error string, opens boolean, "
              "to_end boolean, text binary")
    kind = pa.list_(pa.string()) if form.value_type != "string" else pa.string()
    separator = form.separator.encode()

    class Split:
        """One split while its pieces arrive."""

        def __init__(self, row: dict):
            if row["split"] is None:
                raise RuntimeError("the splits of a file differ between two passes over it: set "
                                   "spark.sql.files.minPartitionNum for both")
            self.__dict__ |= row
            self.before = 0  # records so far
            self.pending: list[bytes] = []
            self.held = 0
            self.whole: list[bytes] = []  # complete records that are not parsed yet

        def add(self, values: list[bytes]) -> Iterator[pa.RecordBatch]:
            for value in values:
                self.pending.append(value)
                self.inside, deeper = form.scan(value, self.inside)
                self.depth += deeper
                if not form.is_boundary(self.inside, self.depth, self.array):
                    continue
                if not self.fresh:
                    yield self.fragment(False, False)
                    self.fresh = True
                    continue
                self.held += sum(map(len, self.pending))
                self.whole.append(separator.join(self.pending))
                self.pending = []
                if self.held > FLUSH_BYTES:
                    yield self.flush()

        def fragment(self, opens: bool, to_end: bool) -> pa.RecordBatch:
            text, self.pending = separator.join(self.pending), []
            return batch([self.split], [self.before], [None], [None], [opens], [to_end], [text])

        def flush(self) -> pa.RecordBatch:
            texts, self.whole, self.held = self.whole, [], 0
            if form.joins():
                texts = [separator.join(texts)]
            found, errors = [], []
            for text in texts:
                values, error = _parsed(form, text, self.latin, self.first, False)
                self.first = False
                found += values
                errors += [error] * len(values)
            at = range(self.before, self.before + len(found))
            self.before += len(found)
            n = len(found)
            return batch([self.split] * n, at, found, errors, *[[None] * n] * 3)

        def finish(self) -> Iterator[pa.RecordBatch]:
            if self.whole:
                yield self.flush()
            if self.pending:
                yield self.fragment(self.fresh, True)
            elif self.last and form.needs_end(self.array):
                yield batch([self.split], [self.before], [None], ["not closed"], [None], [None],
                            [None])

    def batch(split, at, value, error, opens, to_end, text) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(split, pa.int64()), pa.array(at, pa.int64()), pa.array(value, kind),
            pa.array(error, pa.string()), pa.array(opens, pa.bool_()),
            pa.array(to_end, pa.bool_()), pa.array(text, pa.binary()),
        ], names=["split", "at", "value", "error", "opens", "to_end", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for part in batches:
            if not part.num_rows:
                continue
            split = pc.fill_null(part.column("split"), -1).to_numpy()
            for begin, end in _runs([split]):
                if now is None or now.split != split[begin]:
                    if now:
                        yield from now.finish()
                    now = Split({c: part.column(c)[begin].as_py() for c in entry})
                yield from now.add(part.column("piece").slice(begin, end - begin).to_pylist())
        if now:
            yield from now.finish()

    # One small row per split, of which the driver keeps far more to plan the scan.
    known = F.broadcast(states.select("path", "start", *entry))
    return pieces.drop("file_bytes").join(known, ["path", "start"], "left").select(
        *entry, "piece").mapInArrow(run, schema)


def _parsed(
    form: Format, text: bytes, latin: bool, first: bool, last: bool
) -> tuple[list, str | None]:
    """Records of a text; a text that cannot be read is one empty record with the reason."""
    try:
        return form.records(text, latin, first, last), None
    except csv.Error as problem:
        return [None], str(problem)


def _joined_fragments(cut: DataFrame, states: DataFrame, form: Format) -> DataFrame:
    """The records that several splits hold together: (path, start, at, value, error)."""
    schema = f"path string, start bigint, at bigint, value {form.value_type}, error string"
    kind = pa.list_(pa.string()) if form.value_type != "string" else pa.string()
    separator = form.separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                ordered = sorted(row["parts"], key=lambda p: (p["start"], p["opens"]))
                text = separator.join(p["text"] for p in ordered)
                first = any(p["first"] and p["opens"] and not p["at"] for p in ordered)
                last = ordered[-1]["last"] and ordered[-1]["to_end"]
                if last and ordered[0]["trailing"]:
                    text += separator
                values, error = _parsed(form, text, ordered[0]["latin"], first, last)
                n = len(values)
                at = ordered[0]["at"]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["path"]] * n, pa.string()),
                    pa.array([ordered[0]["start"]] * n, pa.int64()),
                    pa.array(range(at, at + n), pa.int64()), pa.array(values, kind),
                    pa.array([error] * n, pa.string()),
                ], names=["path", "start", "at", "value", "error"])

    # At most two fragments a split, so a window over those of a file holds few rows.
    fragments = cut.filter("opens IS NOT NULL").select("split", "at", "opens", "to_end", "text").join(
        F.broadcast(states.select(
            "split", F.col("local_path").alias("path"), "start", "latin", "first", "last", "trailing")), "split")
    order = Window.partitionBy("path").orderBy("start", "opens")
    record = F.sum(F.col("opens").cast("int")).over(order)
    names = fragments.drop("text").withColumn("record", record)
    return names.join(fragments.select("split", "opens", "text"), ["split", "opens"]).groupBy(
        "path", "record").agg(F.collect_list(F.struct(
            "start", "opens", "to_end", "at", "latin", "first", "last", "trailing", "text")).alias("parts")
    ).mapInArrow(run, schema)


def _records(spark: SparkSession, paths: str | list[str], form: Format) -> DataFrame:
    """(local_path, row_no from 0, value, error) of every record, in the order of the file."""
    pieces = _pieces(spark, paths, form.separator)
    states = _entry_states(_summaries(pieces, form), form)
    cut = kept_once(_cut(pieces, states, form))
    whole = cut.filter("opens IS NULL").join(
        F.broadcast(states.select("split", F.col("local_path").alias("path"), "start")), "split")
    rows = whole.select("path", "start", "at", "value", "error").unionByName(
        _joined_fragments(cut, states, form))
    # A record over several splits is numbered with the split that opens it.
    counts = rows.groupBy("path", "start").agg(F.count("*").alias("held"))
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    before = counts.select("path", "start", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias(
        "before"))
    return rows.join(F.broadcast(before), ["path", "start"]).select(
        F.col("path").alias("local_path"), (F.col("before") + F.col("at")).alias("row_no"),
        "value", "error")


def delimited_records(
    spark: SparkSession, paths: str | list[str], delimiter: str = ","
) -> DataFrame:
    """(local_path, row_no, cells, error) of all records of delimited files, headers too.

    Equal to parsing every file as a whole: quoted fields may hold delimiters, quotes and
    line breaks, empty lines are no rows, and a file that is not UTF-8 is read as
    Windows-1252. Empty files have no rows. A text that cannot be parsed is a row with the
    reason and no cells.
    """
    return _records(spark, paths, Delimited(delimiter)).withColumnRenamed("value", "cells")


def json_array_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(local_path, record_no, json) of the elements of files that hold one JSON array.

    Any other file is one record. json is null where the array is not closed; whether an
    element is JSON is for the reader of the text to find out.
    """
    return _records(spark, paths, JsonArray()).select(
        "local_path", F.col("row_no").alias("record_no"), F.col("value").alias("json"))


def json_line_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(local_path, record_no, json) of the lines of JSON Lines files that are not blank."""
    pieces = _pieces(spark, paths, "\n").withColumn("at", F.monotonically_increasing_id())
    lines = pieces.select(
        "path", "start", "at", F.make_valid_utf8(F.col("piece").cast("string")).alias("json")
    ).filter(F.length(F.trim(F.translate("json", "\t\r\n\x0b\x0c", "     "))) > 0)
    lines = kept_once(lines)
    splits = lines.groupBy("path", "start").agg(
        F.count("*").alias("held"), F.min("at").alias("lowest"))
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    before = splits.select(
        "path", "start", _decoded("path").alias("local_path"),
        F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("path", "start").orderBy("at")
    return lines.join(F.broadcast(before), ["path", "start"]).select(
        "local_path",
        (F.col("before") + F.row_number().over(inside) - 1).alias("record_no"), "json")


def with_headers(records: DataFrame) -> DataFrame:
    """(local_path, header, row_no, cells): rows below the first one of their file."""
    headers = records.filter("row_no = 0").select("local_path", F.col("cells").alias("header"))
    body = records.filter("row_no > 0").withColumn("row_no", F.col("row_no") - 1)
    # A huge file has all rows of a key.
    return join_small(body, headers, ["local_path"], F.col("row_no"), is_small(
        headers.select("local_path", F.array_join("header", ",").alias("text")))).select(
        "local_path", "header", "row_no", "cells")


def first_lines(
    spark: SparkSession, paths: str | list[str], lines: int, separator: str = "\n"
) -> DataFrame:
    """(local_path, text) of the first lines of every file, from its first split."""
    numbered = _pieces(spark, paths, separator).filter("start = 0").withColumn(
        "at", F.monotonically_increasing_id())
    begin = numbered.groupBy("path").agg(F.min("at").alias("begin")).withColumn(
        "local_path", _decoded("path"))
    return numbered.join(F.broadcast(begin), "path").filter(
        F.col("at") < F.col("begin") + lines
    ).groupBy("local_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "at", F.make_valid_utf8(F.col("piece").cast("string")).alias("piece")
    ))), lambda line: line["piece"]), separator).alias("text"))
