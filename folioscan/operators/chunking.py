"""Located text chunks from every kind of document.

Input that is one row per document is chunked inside the row, without a shuffle.
Input that is many rows per document (pages, sheet rows, delimited rows, records,
blocks) may hold one document with a large share of all rows; numbering and packing
of those go through `running_before` and `pack_rows`, which split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import schemas, settings
from folioscan.functions import html as hx
from folioscan.functions import json_lines as jx
from folioscan.functions import keys
from folioscan.functions import text as tx
from folioscan.operators.packing import pack_array, pack_rows
from folioscan.operators.running import ordered_join, running_before


def as_chunks(df: DataFrame) -> DataFrame:
    """Complete (doc_id, ordinal, text, locator) to the chunk table's columns."""
    ordinal = F.col("ordinal").cast("int")
    return df.select(
        keys.chunk_id(F.col("doc_id"), ordinal).alias("chunk_id"),
        "doc_id", ordinal.alias("ordinal"), "text", "locator",
        tx.token_estimate(F.col("text")).alias("token_estimate"),
    ).select(*schemas.CHUNKS.names)


def _numbered(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def text_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of plain text, located as `part N`."""
    pieces = tx.pack_paragraphs(tx.universal_newlines(F.col(text)))
    return as_chunks(
        docs.select("doc_id", F.posexplode(pieces).alias("ordinal", "text"))
        .withColumn("locator", _numbered("part ", F.col("ordinal") + 1))
    )


def markdown_titles(docs: DataFrame, text: str = "text") -> DataFrame:
    """First heading of each document; null without one."""
    headings = F.filter(
        tx.markdown_sections(F.col(text)), lambda s: s["heading"] != "preamble"
    )
    return docs.select("doc_id", F.get(headings, F.lit(0))["heading"].alias("title"))


def markdown_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of markdown: one section per heading, which is also the locator."""

    def pieces(section: Column) -> Column:
        shown = F.when(section["heading"] == "preamble", section["body"]).otherwise(
            tx.strip(F.concat(section["heading"], F.lit("\n\n"), section["body"]))
        )
        return F.transform(tx.pack_paragraphs(shown), lambda piece: F.struct(
            piece.alias("text"), section["heading"].alias("locator")
        ))

    sections = tx.markdown_sections(F.col(text))
    return as_chunks(
        docs.select(
            "doc_id",
            F.posexplode(F.flatten(F.transform(sections, pieces))).alias("ordinal", "c"),
        ).select("doc_id", "ordinal", "c.text", "c.locator")
    )


def html_chunks(docs: DataFrame, html: str = "html") -> DataFrame:
    """Chunks of the text of an HTML page, located as `part N`."""
    return text_chunks(docs.select("doc_id", hx.body_text(F.col(html)).alias("text")))


def json_file_chunks(docs: DataFrame, records: str = "records") -> DataFrame:
    """Chunks of files whose flattened records are one array."""

    def pieces(group: Column) -> Column:
        return F.transform(group["pieces"], lambda piece: F.struct(
            piece.alias("text"), record_locator(group["first"], group["last"]).alias("locator")
        ))

    return as_chunks(
        docs.select(
            "doc_id",
            F.posexplode(F.flatten(F.transform(pack_array(F.col(records)), pieces)))
            .alias("ordinal", "c"),
        ).select("doc_id", "ordinal", "c.text", "c.locator")
    )


def record_locator(first: Column, last: Column) -> Column:
    """`record 3` or `records 3-7`, counted from one."""
    return F.when(first == last, _numbered("record ", first + 1)).otherwise(
        F.concat(
            F.lit("records "), (first + 1).cast("string"), F.lit("-"), (last + 1).cast("string")
        )
    )


def record_chunks(records: DataFrame, json: str = "json") -> DataFrame:
    """Chunks of JSON records kept as rows (doc_id, record_no from 0, json).

    A record that is null or does not parse is in `record_rejects` instead.
    """
    flat = records.select(
        "doc_id", "record_no", F.array(jx.flatten_json(F.col(json))).alias("items")
    )
    return as_chunks(
        pack_rows(flat, ["doc_id"], "record_no", "items")
        .withColumn("locator", record_locator(F.col("first_at"), F.col("last_at")))
    )


def record_rejects(records: DataFrame, json: str = "json") -> DataFrame:
    """Records that `record_chunks` leaves out: (doc_id, record_no, error)."""
    return records.filter(
        F.col(json).isNull() | jx.flatten_json(F.col(json)).isNull()
    ).select(
        "doc_id", "record_no",
        F.when(F.col(json).isNull(), F.lit("no record")).otherwise(F.lit("not JSON"))
        .alias("error"),
    )


def table_text(cells: Column) -> Column:
    """Comma-joined rows of a table block; rows without any text are dropped."""

    def row(values: Column) -> Column:
        return F.transform(values, lambda v: F.replace(
            tx.strip(F.coalesce(v, F.lit(""))), F.lit("\n"), F.lit(" ")
        ))

    filled = F.filter(F.transform(cells, row), lambda r: F.exists(r, lambda v: v != ""))
    return F.array_join(F.transform(filled, lambda r: F.array_join(r, ",")), "\n")


def _block_text() -> Column:
    return F.when(F.col("kind") == "table", table_text(F.col("cells"))).otherwise(
        tx.strip(F.col("text"))
    )


def block_titles(blocks: DataFrame) -> DataFrame:
    """First non-blank paragraph of each document."""
    paras = blocks.filter(F.col("kind") == "para").withColumn("_text", _block_text())
    return (
        paras.filter(F.col("_text") != "").groupBy("doc_id")
        .agg(F.min_by("_text", "block_no").alias("title"))
    )


def block_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks of a body of paragraphs and tables, in body order, as `block N`."""
    items = blocks.select("doc_id", "block_no", tx.paragraphs(_block_text()).alias("items"))
    return as_chunks(
        pack_rows(items, ["doc_id"], "block_no", "items")
        .withColumn("locator", _numbered("block ", F.col("ordinal") + 1))
    )


def page_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of page text; pages are packed one by one, ordinals run through."""
    packed = pages.select(
        "doc_id", "page_no", "is_ocr",
        tx.pack_paragraphs(tx.strip(F.col("text"))).alias("_pieces"),
    )
    placed = running_before(
        packed, ["doc_id"], "page_no", weight=F.size("_pieces"), name="_before"
    )
    locator = F.concat(
        F.lit("page "), F.col("page_no").cast("string"),
        F.when(F.col("is_ocr"), F.lit(" (ocr)")).otherwise(F.lit("")),
    )
    return as_chunks(
        placed.select("*", F.posexplode("_pieces").alias("_k", "_piece")).select(
            "doc_id", (F.col("_before") + F.col("_k")).alias("ordinal"),
            F.col("_piece").alias("text"), locator.alias("locator"),
        )
    )


def page_totals(pages: DataFrame) -> DataFrame:
    """Pages and transcribed pages of each document."""
    return pages.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("page_count"),
        F.count_if(F.col("is_ocr")).alias("ocr_pages"),
    )


def joined_cells(cells: Column) -> Column:
    """Cells joined by commas, null as nothing; not quoted, it is for search."""
    return F.array_join(F.transform(cells, lambda v: F.coalesce(v, F.lit(""))), ",")


def delimited_chunks(
    rows: DataFrame, header: Column, size: int = settings.ROWS_PER_CHUNK
) -> DataFrame:
    """Blocks of delimited rows (doc_id, row_no from 0, cells) under their header."""
    blocks = (
        rows.select(
            "doc_id", "row_no", joined_cells(F.col("cells")).alias("_line"),
            header.alias("_header"), F.floor(F.col("row_no") / size).alias("ordinal"),
        )
        .groupBy("doc_id", "ordinal")
        .agg(
            F.first("_header").alias("_header"),
            ordered_join(F.col("_line"), F.col("row_no"), "\n").alias("_body"),
            F.min("row_no").alias("_first"), F.max("row_no").alias("_last"),
        )
    )
    return as_chunks(blocks.select(
        "doc_id", "ordinal",
        F.concat_ws("\n", "_header", "_body").alias("text"),
        F.concat(
            F.lit("rows "), (F.col("_first") + 1).cast("string"), F.lit("-"),
            (F.col("_last") + 1).cast("string"),
        ).alias("locator"),
    ))


def sheet_chunks(rows: DataFrame, size: int = settings.ROWS_PER_CHUNK) -> DataFrame:
    """Blocks of workbook rows (doc_id, sheet_no, sheet, row_no, cells).

    Rows without any text are dropped. The first row left is the header of every
    block of its sheet; a sheet of one row is a block by itself.
    """
    filled = rows.filter(
        F.exists("cells", lambda v: F.coalesce(v, F.lit("")) != "")
    ).select("doc_id", "sheet_no", "sheet", "row_no", joined_cells(F.col("cells")).alias("line"))
    lined = running_before(
        filled, ["doc_id", "sheet_no"], "row_no", name="_at", first_of="line", total="_total"
    )
    only_header = F.col("_total") == 1
    blocks = (
        lined.filter((F.col("_at") > 0) | only_header)
        .withColumn("_block", F.floor(F.greatest(F.col("_at") - 1, F.lit(0)) / size))
        .groupBy("doc_id", "sheet_no", "_block")
        .agg(
            F.first("sheet").alias("sheet"),
            F.first("first_line").alias("_header"),
            F.first("_total").alias("_total"),
            ordered_join(F.col("line"), F.col("_at"), "\n").alias("_body"),
        )
    )
    # One row per sheet carries the number of its blocks to the sheets after it.
    sheets = running_before(
        blocks.filter(F.col("_block") == 0).select(
            "doc_id", "sheet_no",
            F.when(only_header, F.lit(1)).otherwise(F.ceil((F.col("_total") - 1) / size))
            .alias("_blocks"),
        ),
        ["doc_id"], "sheet_no", weight=F.col("_blocks"), name="_before",
    ).select("doc_id", "sheet_no", "_before")
    return as_chunks(blocks.join(sheets, ["doc_id", "sheet_no"]).select(
        "doc_id", (F.col("_before") + F.col("_block")).alias("ordinal"),
        F.when(only_header, F.col("_body"))
        .otherwise(F.concat_ws("\n", "_header", "_body")).alias("text"),
        F.format_string("sheet '%s'", "sheet").alias("locator"),
    ))


def image_chunks(images: DataFrame) -> DataFrame:
    """Chunks of transcribed images (doc_id, text)."""
    pieces = tx.pack_paragraphs(tx.strip(F.coalesce("text", F.lit(""))))
    return as_chunks(
        images.select("doc_id", F.posexplode(pieces).alias("ordinal", "text"))
        .withColumn("locator", F.lit("image"))
    )


def document_text(chunks: DataFrame) -> DataFrame:
    """Whole text of each document: its chunks joined by a blank line, in order."""
    return chunks.groupBy("doc_id").agg(
        ordered_join(F.col("text"), F.col("ordinal"), "\n\n").alias("text")
    )


def document_samples(chunks: DataFrame, chars: int = settings.SAMPLE_CHARS) -> DataFrame:
    """(doc_id, sample): the start of each document's text, as a model sees it.

    A chunk and its separator are three characters or more, so the first `chars` / 3
    chunks hold the whole sample and a huge document is never put together.
    """
    first = chunks.filter(F.col("ordinal") <= chars // 3)
    return document_text(first).select("doc_id", tx.sample(F.col("text"), chars).alias("sample"))
