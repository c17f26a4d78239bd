"""From ranked chunk ids to result rows and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import schemas, settings
from folioscan.functions import text as tx
from folioscan.operators.joins import with_key
from folioscan.sources.shared import checkpointed

BROADCAST_RESULTS = 100_000


def result_rows(
    ranked: DataFrame, chunks: DataFrame, documents: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Complete ranked rows with the nine result columns.

    Text is read only for rows that made the list. `max_rows` is the caller's bound
    on the number of ranked rows; within BROADCAST_RESULTS they are broadcast.
    """
    # The ranking feeds two joins; it is computed once, a list per query.
    ranked = checkpointed(ranked)
    small = max_rows is not None and max_rows <= BROADCAST_RESULTS
    side = F.broadcast if small else (lambda df: df)
    about = documents.select("doc_id", "filename", "source_type", "source_uri", "summary")
    facts = about.join(side(ranked), "doc_id")
    # Only ids are sent to where the text lies; the few texts then meet the few facts.
    texts, ids = chunks.select("chunk_id", "locator", "text"), ranked.select("chunk_id").distinct()
    texts = texts.join(side(ids), "chunk_id", "left_semi") if small else with_key(
        texts, ids, "chunk_id")
    return facts.join(texts, "chunk_id").select(
        *[c for c in ("query_id", "rank") if c in ranked.columns], *schemas.RESULT_COLUMNS
    )


def short_rows(results: DataFrame) -> DataFrame:
    """File name, locator, text and score."""
    return results.select("filename", "locator", "text", "score")


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def result_line(chars: int = settings.SNIPPET_CHARS) -> Column:
    """Three text lines of one result; needs `rank`."""
    return F.format_string(
        "%d. [%.4f] %s (%s, %s)\n   uri: %s\n   %s",
        F.col("rank") + 1, F.col("score"), _shown(F.col("filename")),
        _shown(F.col("source_type")), _shown(F.col("locator")), _shown(F.col("source_uri")),
        tx.snippet(F.col("text"), chars),
    )


def format_results(
    results: DataFrame, limit: int, mode: str | None = None, chars: int = settings.SNIPPET_CHARS
) -> str:
    """Printable form of the results of one query; `limit` bounds what is fetched."""
    rows = results.select("rank", result_line(chars).alias("line")).orderBy("rank").limit(limit)
    shown = [row["line"] for row in rows.collect()]
    if not shown:
        return "No matches."
    return "\n".join(([f"(mode: {mode})"] if mode else []) + shown)
