"""Folders of mixed files: listing and extraction by type.

Small files are a row each. Delimited and JSON files above `SPLIT_BYTES` are cut into
records by many tasks; other files above `ROW_BYTES` are rejects, decided from the listing
before any of them is opened. Text of pages, workbook rows and body blocks that another
tool extracted come as tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schemas, settings
from folioscan.functions import delimited as dx
from folioscan.functions import html as hx
from folioscan.functions import json_lines as jx
from folioscan.functions import keys
from folioscan.functions import text as tx
from folioscan.operators import chunking
from folioscan.operators.joins import is_small, join_small
from folioscan.operators.model_calls import ModelFactory, apply_model
from folioscan.sources import splits
from folioscan.sources.shared import kept_once

# Delimited and JSON files beyond are read in splits; others beyond the second bound not at all.
SPLIT_BYTES = 64 << 20
ROW_BYTES = 512 << 20
SNIFFED_LINES = 1000

INFO = "doc_id string, title string, author string, page_count int"
REJECTS = "doc_id string, local_path string, error string"
# Columns of the binaryFile source.
BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def listing_columns(files: DataFrame) -> DataFrame:
    """Listing of supported files from the columns of the binaryFile source."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = tx.extension(name)
    version = F.unix_micros("modificationTime").cast("string")
    return files.select(
        F.col("path").alias("local_path"),
        F.lit("local").alias("source"),
        F.col("path").alias("source_id"),
        F.col("path").alias("source_uri"),
        version.alias("source_modified"),
        F.lit(None).cast("string").alias("mime_type"),
        name.alias("filename"),
        keys.document_id(F.col("path"), version).alias("doc_id"),
        ext.alias("ext"),
        tx.source_type(ext).alias("source_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"),
        *(["content"] if "content" in files.columns else []),
    ).filter(F.col("source_type").isNotNull())


def _files(spark: SparkSession, folder: str, exts: list[str]) -> DataFrame:
    """binaryFile rows of the files with one of the extensions, in any case.

    The name pattern keeps files of other types from being opened at all.
    """
    def any_case(ext: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)

    pattern = "*{" + ",".join(any_case(e) for e in exts) + "}"
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(folder)
    )


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Listing of the supported files below a folder; no file is opened."""
    return listing_columns(_files(spark, folder, list(settings.EXTENSION_TYPES)).drop("content"))


# From extensions to the listing rows of such files, with their content.
ContentReader = Callable[[list[str]], DataFrame]


def folder_content(
    spark: SparkSession, folder: str, wanted: DataFrame | None = None
) -> ContentReader:
    """Reads files below `folder`: all of them, or those of the `wanted` listing.

    For a part of the folder, files older than every wanted one are not opened, and
    the bytes stay where they are read as long as the wanted list is small.
    """
    oldest, small = None, False
    if wanted is not None:
        oldest = wanted.agg(F.min("modified_at").cast("timestamp")).first()[0]
        small = is_small(wanted.select("doc_id"))

    def read(exts: list[str]) -> DataFrame:
        files = _files(spark, folder, exts)
        if wanted is None:
            return listing_columns(files)
        if oldest is not None:
            files = files.filter(F.col("modificationTime") >= F.lit(oldest))
        ids = wanted.select("doc_id")
        return listing_columns(files).join(
            F.broadcast(ids) if small else ids, "doc_id", "left_semi"
        )

    return read


def extensions_of(kind: str) -> list[str]:
    return [ext for ext, of in settings.EXTENSION_TYPES.items() if of == kind]


@dataclass
class Extracted:
    """What extraction gives: document facts, chunks, metadata and refused files."""

    info: DataFrame
    chunks: DataFrame
    metadata: DataFrame
    rejects: DataFrame


def _info(df: DataFrame, title: Column | None = None, pages: Column | None = None) -> DataFrame:
    nothing = F.lit(None)
    return df.select(
        "doc_id",
        (nothing if title is None else title).cast("string").alias("title"),
        (F.col("author") if "author" in df.columns else nothing).cast("string").alias("author"),
        (nothing if pages is None else pages).cast("int").alias("page_count"),
    )


def _delimited(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, chunks and rejects of delimited files."""
    text = files.select("doc_id", "local_path", dx.decoded(F.col("content")).alias("text"))
    marked = text.select(
        "doc_id", "local_path", "text", dx.sniff_delimiter(F.col("text")).alias("delimiter")
    )
    counted = marked.mapInPandas(
        dx.count_rows, "doc_id string, local_path string, rows bigint, error string")
    body = marked.drop("local_path").mapInPandas(
        dx.parse_rows,
        "doc_id string, header array<string>, row_no bigint, cells array<string>")
    count = F.greatest(F.col("rows") - 1, F.lit(0))
    return _info(counted.filter(F.col("error").isNull()), pages=count), chunking.delimited_chunks(
        body, chunking.joined_cells(F.col("header"))
    ), counted.filter(F.col("error").isNotNull())


def _literal(local_path: str) -> str:
    """A listed path as one in which a reader finds no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", local_path)


def _readable(named: DataFrame) -> list[str]:
    """Paths of large files; Spark itself keeps every one of them to plan a scan."""
    return [_literal(row[0]) for row in named.select("local_path").collect()]


def _one_per_document(rows: DataFrame) -> DataFrame:
    """(doc_id, local_path, error) of the first of several errors of a file."""
    return rows.groupBy("doc_id", "local_path").agg(F.min("error").alias("error"))


def _identified(
    records: DataFrame, named: DataFrame, bad: DataFrame, position: str
) -> DataFrame:
    """Records with the doc_id of their file, without those of refused files."""
    good = named.join(bad.select("doc_id"), "doc_id", "left_anti")
    return join_small(
        records, good.select("doc_id", "local_path"), ["local_path"], F.col(position),
        is_small(good))


def _split_delimited(named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, chunks and rejects of delimited files (doc_id, local_path) of any size.

    The delimiter is judged on the first lines of a file.
    """
    spark = named.sparkSession
    paths = _readable(named)
    marks = splits.first_lines(spark, paths, SNIFFED_LINES).select(
        "local_path", dx.sniff_delimiter(F.col("text")).alias("delimiter")).collect()
    records = reduce(DataFrame.unionByName, [
        splits.delimited_records(
            spark, [_literal(r.local_path) for r in marks if r.delimiter == mark], mark)
        for mark in sorted({r.delimiter for r in marks})])
    bad = kept_once(_one_per_document(
        records.filter(F.col("error").isNotNull()).join(named, "local_path")))
    rows = _identified(splits.with_headers(records.drop("error")), named, bad, "row_no")
    count = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    whole = named.join(bad, "doc_id", "left_anti").join(count, "doc_id", "left")
    info = _info(whole, pages=F.coalesce("rows", F.lit(0)))
    return info, chunking.delimited_chunks(rows, chunking.joined_cells(F.col("header"))), bad


def _split_json(named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, chunks and rejects of JSON files (doc_id, local_path, ext) of any size.

    A file of this size that is no array is read as lines.
    """
    spark = named.sparkSession
    paths = _readable(named)
    marked = splits.first_lines(spark, paths, 1, ",").select(
        "local_path", F.ltrim(F.regexp_replace("text", "^[\\x{feff}\\s]+", "")).startswith("[")
        .alias("array"))
    kinds = named.join(marked, "local_path").select("local_path", F.when(
        F.col("ext") == ".jsonl", False).otherwise(F.col("array")).alias("array")).collect()
    records = reduce(DataFrame.unionByName, [
        read(spark, [_literal(r.local_path) for r in kinds if r.array == array])
        for array, read in ((True, splits.json_array_records), (False, splits.json_line_records))
        if any(r.array == array for r in kinds)])
    known = kept_once(join_small(
        records, named.select("doc_id", "local_path"), ["local_path"], F.col("record_no"),
        is_small(named)))
    broken = chunking.record_rejects(known).withColumn("error", F.concat(
        F.lit("record "), (F.col("record_no") + 1).cast("string"), F.lit(": "), F.col("error")))
    bad = kept_once(_one_per_document(broken.join(
        named.select("doc_id", "local_path"), "doc_id")))
    rows = join_small(known, bad.select("doc_id"), ["doc_id"], F.col("record_no"), is_small(
        bad.select("doc_id")), "left_anti")
    count = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    whole = named.join(bad, "doc_id", "left_anti").join(count, "doc_id", "left")
    info = _info(whole, pages=F.coalesce("rows", F.lit(0)))
    return info, chunking.record_chunks(rows.select("doc_id", "record_no", "json")), bad


def extract(
    listing: DataFrame,
    content: ContentReader,
    effort: str | None = None,
    transcribe: ModelFactory | None = None,
    pages: DataFrame | None = None,
    sheets: DataFrame | None = None,
    blocks: DataFrame | None = None,
    split_bytes: int = SPLIT_BYTES,
    row_bytes: int = ROW_BYTES,
) -> Extracted:
    """Route every listed file to the extraction of its type.

    `content` reads the files of text types. `pages` (local_path, page_no, text and,
    for transcription, image), `sheets` (local_path, sheet_no, sheet, row_no, cells) and
    `blocks` (local_path, block_no, kind, text, cells) hold what was extracted from
    pdf, xlsx and docx files. `transcribe` turns image paths into text. A file that
    cannot be read lands in the rejects with the reason; the others go on. Delimited and
    JSON files of more than `split_bytes` are read from their paths by many tasks; text
    and HTML files of more than `row_bytes` are rejects.
    """
    read, by_splits = content, F.col("source_type").isin("csv", "json")
    most = F.when(by_splits, split_bytes).otherwise(row_bytes)

    def content(exts: list[str]) -> DataFrame:
        # A bound on the file length is decided before the file is opened.
        files = read(exts)
        bound = split_bytes if set(exts) <= set(
            extensions_of("csv") + extensions_of("json")) else row_bytes
        return files.filter(F.coalesce(F.col("size_bytes"), F.lit(0)) <= bound)

    profile = settings.effort_profile(effort)
    spark = listing.sparkSession
    # At most one value per type; types that do not occur add nothing to the plan.
    present, huge = set(), set()
    for kind, above in listing.select(
        "source_type", F.coalesce(F.col("size_bytes") > most, F.lit(False))
    ).distinct().collect():
        present.add(kind)
        if above:
            huge.add(kind)
    large = listing.filter(F.col("size_bytes") > most)
    infos = [spark.createDataFrame([], INFO)]
    chunks = [spark.createDataFrame([], schemas.CHUNKS)]
    metadata = [spark.createDataFrame([], schemas.DOC_METADATA)]
    rejects = [spark.createDataFrame([], REJECTS)]

    def reject(df: DataFrame, reason: Column) -> None:
        rejects.append(df.select("doc_id", "local_path", reason.alias("error")))

    if "text" in present:
        markdown = content([".md"]).withColumn("text", dx.utf8_text(F.col("content")))
        plain = content([".txt"]).withColumn("text", dx.utf8_text(F.col("content")))
        titles = chunking.markdown_titles(markdown)
        infos += [_info(titles, title=F.col("title")), _info(plain)]
        chunks += [chunking.markdown_chunks(markdown), chunking.text_chunks(plain)]

    if "html" in present:
        html = content(extensions_of("html")).select(
            "doc_id", dx.utf8_text(F.col("content")).alias("html")
        )
        infos.append(_info(html, title=hx.title(F.col("html"))))
        chunks.append(chunking.html_chunks(html))

    if "csv" in present:
        info, rows, broken = _delimited(content(extensions_of("csv")))
        infos.append(info)
        chunks.append(rows)
        reject(broken, F.col("error"))

    if "json" in present:
        parsed = content(extensions_of("json")).select(
            "doc_id", "local_path",
            jx.json_records(dx.utf8_text(F.col("content")), F.col("ext")).alias("j"),
        ).select("doc_id", "local_path", "j.*")
        readable = parsed.filter(F.col("error").isNull())
        infos.append(_info(readable, pages=F.size("records")))
        chunks.append(chunking.json_file_chunks(readable))
        reject(parsed.filter(F.col("error").isNotNull()), F.col("error"))

    for kind, split in (("csv", _split_delimited), ("json", _split_json)):
        if kind in huge:
            info, rows, broken = split(kept_once(
                large.filter(F.col("source_type") == kind).select("doc_id", "local_path", "ext")))
            infos.append(info)
            chunks.append(rows)
            reject(broken, F.col("error"))
    if huge & {"text", "html"}:
        reject(large.filter(F.col("source_type").isin("text", "html")), F.concat(
            F.lit(f"larger than {row_bytes} bytes: "), F.col("size_bytes").cast("string")))

    images = listing.filter(F.col("source_type") == "image").select("doc_id", "local_path")
    if "image" in present and transcribe:
        seen = kept_once(apply_model(
            images, "local_path", "text", "string", transcribe, profile.vision_model
        ))
        good = seen.filter(F.col("error").isNull())
        infos.append(_info(good))
        chunks.append(chunking.image_chunks(good))
        metadata.append(good.select(
            "doc_id", F.lit("vision_model").alias("key"), F.lit(profile.vision_model).alias("value")
        ))
        reject(seen.filter(F.col("error").isNotNull()), F.col("error"))
    elif "image" in present:
        reject(images, F.lit("no transcription function was given"))

    for kind, rows in (("pdf", pages), ("xlsx", sheets), ("docx", blocks)):
        if kind not in present:
            continue
        named = listing.filter(F.col("source_type") == kind).select("doc_id", "local_path")
        if rows is None:
            reject(named, F.lit(f"no extracted content was given for {kind} files"))
            continue
        given = rows.join(named, "local_path")
        absent = named.join(rows.select("local_path"), "local_path", "left_anti")
        reject(absent, F.lit(f"no extracted content was given for {kind} files"))
        if kind == "pdf":
            given, unread = transcribed_pages(given, profile, transcribe)
            reject(unread, F.concat(
                F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), F.col("error")))
            totals = chunking.page_totals(given)
            infos.append(_info(totals, pages=F.col("page_count")))
            chunks.append(chunking.page_chunks(given))
            metadata.append(totals.filter(F.col("ocr_pages") > 0).select(
                "doc_id", F.lit("ocr_pages").alias("key"),
                F.col("ocr_pages").cast("string").alias("value"),
            ))
        elif kind == "xlsx":
            infos.append(_info(given.select("doc_id").distinct()))
            chunks.append(chunking.sheet_chunks(given))
        else:
            titles = chunking.block_titles(given)
            infos.append(_info(
                given.select("doc_id").distinct().join(titles, "doc_id", "left"),
                title=F.col("title"),
            ))
            chunks.append(chunking.block_chunks(given))

    return Extracted(*(
        reduce(DataFrame.unionByName, parts) for parts in (infos, chunks, metadata, rejects)
    ))


def transcribed_pages(
    pages: DataFrame, profile: settings.Tier, transcribe: ModelFactory | None
) -> tuple[DataFrame, DataFrame]:
    """Pages with the text of blank ones read from their image, where the tier allows.

    The second table has the pages whose transcription failed, with the error; they keep
    their blank text.
    """
    blank = tx.strip(F.coalesce("text", F.lit(""))) == ""
    columns = ["doc_id", "page_no", "text"]
    plain = pages.select(*columns, F.lit(False).alias("is_ocr"))
    if not (profile.ocr_fallback and transcribe and "image" in pages.columns):
        return plain, pages.limit(0).select(
            "doc_id", "local_path", "page_no", F.lit(None).cast("string").alias("error"))
    seen = kept_once(apply_model(
        pages.filter(blank).select("doc_id", "local_path", "page_no", "image"),
        "image", "text", "string", transcribe, profile.vision_model,
    ))
    failed = F.col("error").isNotNull()
    return pages.filter(~blank).select(*columns, F.lit(False).alias("is_ocr")).unionByName(
        seen.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"),
                    (~failed).alias("is_ocr"))
    ), seen.filter(failed).select("doc_id", "local_path", "page_no", "error")
