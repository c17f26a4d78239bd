"""Search jobs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import schemas, settings
from folioscan.operators import fusion, lexical, results
from folioscan.operators.filters import Filters, restrict
from folioscan.operators.joins import is_small
from folioscan.operators.model_calls import ModelFactory
from folioscan.operators.ranking import top_k
from folioscan.plans.backfill import embed
from folioscan.plans.ingest import STEMMER_SETTING
from folioscan.sources.catalog import Catalog
from folioscan.sources.shared import checkpointed
from folioscan.sources.vector_store import vector_store

# Up to this many distinct query terms are named in the scan of the postings.
LISTED_TERMS = 500
# Spark's default of values in one pushed list that are compared one by one.
PUSHED_VALUES = 10


def lexical_scores(
    chunks: DataFrame,
    queries: DataFrame,
    stemmer: str | None = "porter",
    allowed: DataFrame | None = None,
    best: int | None = None,
) -> DataFrame:
    """BM25 of a query table over chunks that have no stored index.

    The postings of the query terms are computed once and kept: they give the document
    frequencies, the totals and the scores. `allowed` (doc_id) restricts what is scored,
    not the statistics. With `best`, only rows that a `top_k` of that depth may need.
    """
    wanted = lexical.query_terms(queries, stemmer=stemmer)
    small = is_small(wanted)
    # Lengths come along with the terms: the chunks are cut into tokens once.
    named = wanted.select("term").unionByName(
        wanted.sparkSession.createDataFrame([(lexical.NO_TERM,)], "term string"))
    found = checkpointed(lexical.matching_postings(
        lexical.build_postings(chunks, stemmer, lengths=True), named, small))
    postings = found.filter(F.col("term") != lexical.NO_TERM)
    totals = found.filter(F.col("term") == lexical.NO_TERM).agg(
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("total_len"))
    kept = postings if allowed is None else postings.join(
        allowed.select("doc_id"), "doc_id", "left_semi"
    )
    return lexical.score(
        kept, lexical.document_frequencies(postings),
        totals, wanted, small, best=best,
    )


def check_mode(mode: str) -> None:
    """Reject an unknown mode before anything is planned."""
    if mode not in settings.SEARCH_MODES:
        raise ValueError(f"mode must be one of {list(settings.SEARCH_MODES)}, not {mode!r}")


def resolve_mode(catalog: Catalog, mode: str) -> str:
    """The mode that will run; hybrid for `auto` once there is a vector."""
    check_mode(mode)
    embedded = bool(catalog.table("chunk_embeddings").limit(1).count())
    if mode == "auto":
        return "hybrid" if embedded else "bm25"
    if mode in ("vector", "hybrid") and not embedded:
        raise RuntimeError("this catalog has no embeddings yet: run a backfill first")
    return mode


def named_terms(terms: list[str]) -> Column:
    """Whether `term` is one of the terms, in a form that the scan checks one by one.

    Of a longer list the Parquet reader would only check the least and the largest.
    """
    groups = [terms[i:i + PUSHED_VALUES] for i in range(0, len(terms), PUSHED_VALUES)]
    return reduce(or_, [F.col("term").isin(*g) for g in groups], F.lit(False))


def lexical_top_k(
    catalog: Catalog, queries: DataFrame, limit: int, wanted: Filters
) -> DataFrame:
    """Best chunks per query from the stored index.

    The terms of a small query table are put into the scan as a list, so that row
    groups of the sorted postings without any of them are skipped.
    """
    stemmer = catalog.setting(STEMMER_SETTING) or "porter"
    terms = lexical.query_terms(queries, stemmer=None if stemmer == "none" else stemmer)
    small = is_small(terms)
    # The partial sums as they lie: only those of the terms are summed up.
    frequencies, known = catalog.stored("term_stats").select("term", "df"), F.lit(True)
    listed = terms.select("term").distinct().limit(LISTED_TERMS + 1).collect()
    if len(listed) <= LISTED_TERMS:
        known = named_terms([row["term"] for row in listed])
        frequencies = frequencies.filter(known)
    # Filtering postings, not scores, keeps pairs of query and chunk out of the join;
    # the statistics come from their own tables and do not change.
    matching = restrict(
        catalog.stored("postings", only=lambda postings: lexical.matching_postings(
            postings.filter(known), terms, small)).select(*schemas.POSTINGS.names),
        catalog.table("documents"), catalog.table("tags"), wanted,
    )
    scores = lexical.score(
        matching, frequencies, catalog.table("corpus_stats"), terms, small, best=limit
    )
    return top_k(scores, limit)


def search(
    catalog: Catalog,
    query: str | DataFrame,
    limit: int = 10,
    types: list[str] | None = None,
    tags: list[str] | None = None,
    source: str | None = None,
    mode: str = "auto",
    embed_query: ModelFactory | None = None,
) -> tuple[DataFrame, str]:
    """Result rows (with query_id and 0-based rank) and the mode that ran.

    `query` is one text or a table (query_id, text). `embed_query` is the query-side
    embedder of the locked model; the built-in one needs none.
    """
    mode = resolve_mode(catalog, mode)
    queries = query if isinstance(query, DataFrame) else catalog.spark.createDataFrame(
        [(0, query)], "query_id bigint, text string"
    )
    wanted = Filters.of(types, tags, source)
    pool = fusion.pool_size(limit) if mode == "hybrid" else limit
    if mode in ("vector", "hybrid"):
        store = vector_store(catalog)
        vectors = embed(queries, store.locked_model(), embed_query)
        dense = store.search(vectors.select("query_id", "embedding"), pool, wanted)
    if mode in ("bm25", "hybrid"):
        words = lexical_top_k(catalog, queries, pool, wanted)
    if mode == "hybrid":
        ranked = fusion.fuse(words, dense, limit)
    else:
        ranked = words if mode == "bm25" else dense
    max_rows = None if isinstance(query, DataFrame) else limit
    found = results.result_rows(
        ranked, catalog.table("chunks"), catalog.table("documents"), max_rows
    )
    return found.orderBy("query_id", "rank"), mode
