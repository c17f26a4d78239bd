"""Keyword tags and tier-driven enrichment."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan import settings
from folioscan.functions import text as tx
from folioscan.functions.terms import KEYWORD
from folioscan.operators.chunking import document_samples
from folioscan.operators.joins import is_small, with_key
from folioscan.operators.model_calls import ModelFactory, apply_model
from folioscan.sources.shared import kept_once

# Chunks of a document that are counted together.
PIECE_CHUNKS = 256
ROWS_AT_ONCE = 10_000
_KEYWORD = re.compile(KEYWORD.encode())
_STOP_WORDS = frozenset(w.encode() for w in settings.STOP_WORDS)


def _piece_counts(chunks: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, term, n, first), counted per piece of a document while its chunks pass by.

    A piece has PIECE_CHUNKS ordinals, so most documents are one piece, and a huge one is
    many. With `k`, a document of one piece gives its `k` first terms only.
    """
    piece = _piece()
    text = F.col("text").cast("binary")
    # Later pieces leave a mark without text with the first one, which then is not all.
    mark = F.struct(F.lit(0).cast("bigint").alias("piece"), F.lit(None).cast("binary").alias("text"),
                    F.lit(False).alias("alone"))
    own = F.struct(piece.alias("piece"), text.alias("text"), (piece == 0).alias("alone"))
    rows = chunks.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.explode(
        F.when(piece > 0, F.array(own, mark)).otherwise(F.array(own))).alias("p")).select(
        "doc_id", "ordinal", "p.*")
    return rows.repartition("doc_id", "piece").sortWithinPartitions(
        "doc_id", "piece").mapInArrow(*_counting(rows, k))


def _piece() -> Column:
    return F.greatest(F.floor(F.col("ordinal") / PIECE_CHUNKS), F.lit(0))


def _counting(rows: DataFrame, k: int | None) -> tuple[Callable, str]:
    """What counts the terms of pieces that pass by, and its schema.

    `place` numbers the terms of a piece; with `k`, by rank where it is alone.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "term", "n", "first", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, alone, counts, firsts, found = None, True, Counter(), {}, []

        def finished() -> None:
            terms = [(key[0], w, n, firsts[w]) for w, n in counts.items()]
            if alone and k is not None:
                terms = nsmallest(k, terms, key=lambda t: (-t[2], t[3] is not None, t[3]))
            found.extend((*t, place) for place, t in enumerate(terms))

        def flushed(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = kind, pa.binary(), pa.int64(), pa.int64(), pa.int32()
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            arrays[1] = arrays[1].cast(pa.string())
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        doc_kind = None
        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            for doc, ordinal, at, text, only in zip(
                    *(batch.column(c).to_pylist() for c in
                      ("doc_id", "ordinal", "piece", "text", "alone")), strict=True):
                if key != (doc, at):
                    if key is not None:
                        finished()
                        if len(found) >= ROWS_AT_ONCE:
                            yield flushed(doc_kind)
                    key, alone, counts, firsts = (doc, at), True, Counter(), {}
                alone &= only
                words = [w for w in _KEYWORD.findall((text or b"").lower()) if w not in _STOP_WORDS]
                counts.update(words)
                if ordinal is None:
                    for word in words:
                        firsts.setdefault(word, None)
                    continue
                begin = ordinal << 32
                # Of equal words, the one put in last is the first one.
                places = range(begin + len(words) - 1, begin - 1, -1)
                for word, place in dict(zip(reversed(words), places, strict=True)).items():
                    seen = firsts.get(word)
                    if seen is None or place < seen:
                        firsts[word] = place
        if key is not None:
            finished()
            yield flushed(doc_kind)

    return run, f"doc_id {kind}, term string, n bigint, first bigint, place int"


def term_frequencies(chunks: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, term, n, first): counted per piece first, then per document.

    `first` is one number, chunk ordinal before position. With `k`, at least the `k` most
    frequent terms of a document, ties by first occurrence.
    """
    return _piece_counts(chunks, k).groupBy("doc_id", "term").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"))


def keyword_tags(chunks: DataFrame, k: int = settings.TAGS_PER_DOCUMENT) -> DataFrame:
    """(doc_id, tag, tag_rank): the most frequent words, ties by first occurrence.

    Where all chunks of a document follow one another in a task, as they are stored, its
    words are ranked there. Only documents that turn up twice are counted by a shuffle.
    """
    rows = chunks.select(
        "doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), _piece().alias("piece"),
        F.col("text").cast("binary").alias("text"), F.lit(True).alias("alone"))
    found = kept_once(rows.mapInArrow(*_counting(rows, k)))
    twice = found.filter((F.col("place") == 0) & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    small = is_small(twice)
    once = found.filter(F.col("doc_id").isNotNull()).join(
        F.broadcast(twice) if small else twice, "doc_id", "left_anti")
    others = with_key(chunks, twice, "doc_id").unionByName(
        chunks.filter(F.col("doc_id").isNull()))
    return once.select(
        "doc_id", F.col("term").alias("tag"), (F.col("place") + 1).alias("tag_rank")
    ).unionByName(_ranked_terms(others, k))


def _ranked_terms(chunks: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return (
        term_frequencies(chunks, k)
        .withColumn("tag_rank", F.row_number().over(order))
        .filter(F.col("tag_rank") <= k)
        .select("doc_id", F.col("term").alias("tag"), "tag_rank")
    )


def normalised_tags(tags: Column, k: int = settings.MODEL_TAGS_PER_DOCUMENT) -> Column:
    """Model tags in lower case, stripped, without blanks, the first `k`."""
    clean = F.transform(tags, lambda t: tx.strip(F.lower(t)))
    return F.slice(F.filter(clean, lambda t: t != ""), 1, k)


def enrich(
    chunks: DataFrame,
    effort: str | None = None,
    summarise: ModelFactory | None = None,
    tag: ModelFactory | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Summaries (doc_id, summary) and tags (doc_id, tag) of the tier.

    The low tier uses keywords only. The high tier sends the sample of each document
    with text to the caller's functions; a failed summary stays null and failed tags
    fall back to keywords.
    """
    profile = settings.effort_profile(effort)
    by_models = [p and m for p, m in (
        (profile.enrich_summary, summarise), (profile.enrich_tags, tag))]
    sampled = document_samples(chunks)
    if all(by_models):
        sampled = kept_once(sampled)  # both models read it
    summaries = chunks.select(
        "doc_id", F.lit(None).cast("string").alias("summary")
    ).distinct()
    if profile.enrich_summary and summarise:
        answers = kept_once(apply_model(
            sampled, "sample", "summary", "string", summarise, profile.text_model))
        summaries = answers.select("doc_id", tx.strip(F.col("summary")).alias("summary"))

    if not (profile.enrich_tags and tag):
        return summaries, keyword_tags(chunks).select("doc_id", "tag")
    answers = kept_once(apply_model(
        sampled, "sample", "tags", "array<string>", tag, profile.text_model))
    failed = answers.filter(F.col("error").isNotNull()).select("doc_id")
    answered = answers.filter(F.col("error").isNull()).select(
        "doc_id", F.explode(F.array_distinct(normalised_tags(F.col("tags")))).alias("tag")
    )
    unanswered = chunks.join(failed, "doc_id", "left_semi")
    fallback = keyword_tags(unanswered).select("doc_id", "tag")
    return summaries, answered.unionByName(fallback)
