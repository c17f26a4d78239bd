"""BM25 over a table of postings.

idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a chunk scores the sum over the distinct
query terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg_len)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan import schemas, settings
from folioscan.functions import terms as tm
from folioscan.operators.joins import join_small
from folioscan.operators.ranking import BestOfBlocks, stable_score, top_k
from folioscan.sources.shared import checkpointed

STEMMERS = ("porter", None)
# Sums of chunks and queries that a task holds at a time.
SUMS_AT_ONCE = 1 << 19
NO_TERM = ""
# Chunks whose terms a task counts at a time.
CHUNKS_AT_ONCE = 2048
# Postings that a task puts together by chunk before they are shuffled.
POSTINGS_AT_ONCE = 1 << 20


def tokens(text: Column, stemmer: str | None = "porter") -> Column:
    """Index tokens of a text; the query side must use the same stemmer."""
    if stemmer not in STEMMERS:
        raise ValueError(f"stemmer must be one of {STEMMERS}, not {stemmer!r}")
    plain = tm.lexical_tokens(text)
    return tm.stem_tokens(plain) if stemmer else plain


def build_postings(
    chunks: DataFrame, stemmer: str | None = "porter", lengths: bool = False
) -> DataFrame:
    """(term, chunk_id, doc_id, tf, len), counted in the task that has the chunk.

    With `lengths`, one row more of every chunk, also one without a token: term NO_TERM, tf 0.
    """
    if stemmer not in STEMMERS:
        raise ValueError(f"stemmer must be one of {STEMMERS}, not {stemmer!r}")
    ids = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")}
    names = ["term", *ids, "tf", "len"]
    dropped = pa.array([b"", *(w.encode() for w in settings.STOP_WORDS)], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNKS_AT_ONCE):
                yield counted(batch.slice(start, CHUNKS_AT_ONCE))

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        words = pc.split_pattern_regex(part.column("folded"), "[^a-z]+")
        found = pc.list_flatten(words).dictionary_encode()
        codes, values = found.indices.to_numpy(), found.dictionary
        kept = ~pc.is_in(values, dropped).to_numpy(zero_copy_only=False)[codes]
        rows = pc.list_parent_indices(words).to_numpy()[kept]
        terms = values.cast(pa.string())
        if stemmer:
            stems = pa.array(map(tm.porter_stem, terms.to_pylist()), pa.string())
            found = stems.dictionary_encode()
            codes, terms = found.indices.to_numpy()[codes], found.dictionary
        length = np.bincount(rows, minlength=part.num_rows).astype(np.int32)
        width = max(1, len(terms))
        pairs, tf = np.unique(rows * width + codes[kept], return_counts=True)
        row, term = pairs // width, terms.take(pa.array(pairs % width))
        if lengths:
            row, tf = np.r_[row, np.arange(part.num_rows)], np.r_[tf, np.zeros(part.num_rows)]
            term = pa.concat_arrays([term, pa.array([NO_TERM] * part.num_rows, pa.string())])
        return pa.RecordBatch.from_arrays([
            term, *(part.column(c).take(pa.array(row)) for c in ids),
            pa.array(tf.astype(np.int32)), pa.array(length[row])], names=names)

    # Letters are folded as for the tokens of a query.
    folded = tm.folded(F.col("text")).cast("binary")
    return chunks.select(*ids, folded.alias("folded")).mapInArrow(
        run, f"term string, chunk_id {ids['chunk_id']}, doc_id {ids['doc_id']}, tf int, len int"
    ).select(*schemas.POSTINGS.names)


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df): in how many chunks a term occurs."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_totals(chunks: DataFrame, stemmer: str | None = "porter") -> DataFrame:
    """One row (n_chunks, total_len) over all chunks, also those without a token."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum(F.size(tokens(F.col("text"), stemmer))), F.lit(0))
        .cast("bigint").alias("total_len"),
    )


def query_terms(queries: DataFrame, text: str = "text", stemmer: str | None = "porter") -> DataFrame:
    """Distinct (query_id, term)."""
    return queries.select(
        "query_id", F.explode(F.array_distinct(tokens(F.col(text), stemmer))).alias("term")
    )


def matching_postings(postings: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Postings of the wanted terms."""
    terms = wanted.select("term").distinct()
    return join_small(postings, terms, ["term"], F.col("chunk_id"), small, "left_semi")


def _weights(
    frequencies: DataFrame, totals: DataFrame, wanted: DataFrame, small: bool
) -> tuple[DataFrame, float]:
    """(query_id, term, _idf), and the mean length of a chunk."""
    n, length = totals.agg(
        F.coalesce(F.sum("n_chunks"), F.lit(0)), F.coalesce(F.sum("total_len"), F.lit(0))
    ).first()
    known = join_small(frequencies, wanted, ["term"], F.col("df"), small)
    # One row per query term again, so as small as the query terms.
    weights = known.groupBy("query_id", "term").agg(F.sum("df").alias("df")).select(
        "query_id", "term",
        F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("_idf"),
    )
    return weights, length / n if length else 1.0


def _part(tf: Column, length: Column, avg_len: float, k1: float, b: float) -> Column:
    """What a term adds to a score: more with its frequency, less with the length."""
    return F.col("_idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(avg_len)))


def score(
    matching: DataFrame,
    frequencies: DataFrame,
    totals: DataFrame,
    wanted: DataFrame,
    small: bool,
    k1: float = settings.BM25_K1,
    b: float = settings.BM25_B,
    best: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, doc_id, score) of every chunk with a query term.

    With `best`, a task returns only rows that are among its so many first ones of a query:
    enough for a `top_k` of at most that depth.

    `matching` comes from `matching_postings`; `small` says whether the query terms
    may be broadcast. `frequencies` and `totals` may be partial sums per catalog part.
    They always describe the whole corpus: filters on documents come after scoring.

    The only large shuffle brings the postings of a chunk together. It carries each
    posting once, however many queries ask for its term, as two numbers in a row of its
    chunk. Sorted by chunk they pass through the task, which adds up one block of chunks at
    a time for all queries: pairs of query and chunk are neither shuffled nor kept.
    """
    weights, avg_len = _weights(frequencies, totals, wanted, small)
    if small:
        kind = weights.schema["query_id"].dataType.simpleString()
        return _summed(matching, weights.toArrow(), kind, avg_len, k1, b, best)
    matched = join_small(matching, weights, ["term"], F.col("chunk_id"), small)
    part = _part(F.col("tf"), F.col("len"), avg_len, k1, b)
    return (
        matched.groupBy("query_id", "chunk_id", "doc_id")
        .agg(stable_score(F.sum(part)).alias("score"))
    )


def _summed(
    postings: DataFrame, weights: pa.Table, kind: str, avg_len: float, k1: float, b: float,
    best: int | None,
) -> DataFrame:
    """Scores of postings, for the few weights (query_id, term, _idf)."""
    asked = weights.column("query_id").combine_chunks().unique()
    terms = weights.column("term").combine_chunks().unique()
    of_term = pc.index_in(weights.column("term"), terms).to_numpy()
    order = np.argsort(of_term, kind="stable")
    known = postings.sparkSession.sparkContext.broadcast((
        asked, terms, np.searchsorted(of_term[order], np.arange(len(terms) + 1)),
        pc.index_in(weights.column("query_id"), asked).to_numpy()[order],
        weights.column("_idf").to_numpy()[order]))
    names = ["query_id", "chunk_id", "doc_id", "score"]

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            term = pc.index_in(batch.column("term"), known.value[1])
            held.append(pa.RecordBatch.from_arrays(
                [term, *(batch.column(c) for c in ("chunk_id", "doc_id", "tf", "len"))],
                names=["term", "chunk_id", "doc_id", "tf", "len"]).filter(term.is_valid()))
            count += held[-1].num_rows
            if count >= POSTINGS_AT_ONCE:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = [rows.column(c) for c in ("chunk_id", "doc_id", "len")]
        codes = [x.dictionary_encode(null_encoding="encode").indices.to_numpy() for x in ids]
        order = np.lexsort(codes[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in codes], axis=0)
        begins = np.flatnonzero(new)
        ends = pa.array(np.r_[begins, len(order)].astype(np.int32))
        first = pa.array(order[begins])
        return pa.RecordBatch.from_arrays([
            *(x.take(first) for x in ids),
            *(pa.ListArray.from_arrays(ends, rows.column(c).take(pa.array(order)))
              for c in ("term", "tf"))], names=["chunk_id", "doc_id", "len", "terms", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, terms, starts, queries, idf = known.value
        width = len(asked)
        if not width:
            return
        leaders = BestOfBlocks(width, best) if best is not None else None
        held = None  # ids, sums and hits of the last chunk, which may go on in the next batch

        def finished(chunks: pa.Array, docs: pa.Array, sums, hit) -> Iterator[pa.RecordBatch]:
            if leaders is not None:
                leaders.add(np.where(hit, sums, -np.inf).T,
                            *(x.to_numpy(zero_copy_only=False) for x in (chunks, docs)))
                return
            row, column = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([
                asked.take(pa.array(column)), chunks.take(pa.array(row)),
                docs.take(pa.array(row)),
                pa.array(np.round(sums[row, column], settings.SCORE_DIGITS)),
            ], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            of_row = pc.list_parent_indices(batch.column("terms"))
            chunks, docs = (
                batch.column(c).cast(pa.string()).take(of_row) for c in ("chunk_id", "doc_id"))
            codes = [x.dictionary_encode(null_encoding="encode").indices.to_numpy()
                     for x in (chunks, docs)]
            new = np.r_[True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])]
            begins = np.flatnonzero(new)
            first = chunks[0].as_py(), docs[0].as_py()
            if held is not None and held[0] != first:
                yield from finished(*(pa.array([x], pa.string()) for x in held[0]), *held[1:])
                held = None
            tf = batch.column("tfs").flatten().to_numpy().astype(np.float64)
            length = batch.column("len").take(of_row).to_numpy()
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
            term = batch.column("terms").flatten().to_numpy()
            pairs = starts[term + 1] - starts[term]
            ends = np.r_[begins[1:], len(term)]
            size = max(1, SUMS_AT_ONCE // width)
            for at in range(0, len(begins), size):
                here = begins[at:at + size]
                sums, hit = np.zeros(len(here) * width), np.zeros(len(here) * width, bool)
                low, high = here[0], ends[min(at + size, len(begins)) - 1]
                place = (np.cumsum(new[low:high]) - 1) * width
                while low < high:
                    # As many postings as make a bounded number of pairs, one at least.
                    made = np.cumsum(pairs[low:high])
                    upto = low + max(1, int(np.searchsorted(made, SUMS_AT_ONCE, "right")))
                    n = pairs[low:upto]
                    at_pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(
                        starts[term[low:upto]], n)
                    key = np.repeat(place[:upto - low], n) + queries[at_pair]
                    sums += np.bincount(
                        key, idf[at_pair] * np.repeat(part[low:upto], n), len(sums))
                    hit[key] = True
                    place, low = place[upto - low:], upto
                sums, hit = sums.reshape(-1, width), hit.reshape(-1, width)
                if at == 0 and held is not None:
                    sums[0] += held[1][0]
                    hit[0] |= held[2][0]
                    held = None
                if at + size >= len(begins):
                    held = (chunks[here[-1]].as_py(), docs[here[-1]].as_py()), sums[-1:], hit[-1:]
                    here, sums, hit = here[:-1], sums[:-1], hit[:-1]
                if len(here):
                    mine = pa.array(here)
                    yield from finished(chunks.take(mine), docs.take(mine), sums, hit)
        if held is not None:
            yield from finished(*(pa.array([x], pa.string()) for x in held[0]), *held[1:])
        if leaders is not None:
            leaders.settle()
            yield pa.RecordBatch.from_arrays([
                asked.take(pa.array(leaders.rows)), pa.array(leaders.ids, pa.string()),
                pa.array(leaders.docs, pa.string()), pa.array(leaders.scores, pa.float64()),
            ], names=names)

    # Terms are numbered, and what a task has of a chunk is one row, before the shuffle.
    ids = {c: postings.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")}
    rows = postings.select("term", *ids, "tf", "len").mapInArrow(by_chunk, ", ".join(
        [f"{c} {t}" for c, t in ids.items()] + ["len int, terms array<int>, tfs array<int>"]))
    return rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "doc_id").mapInArrow(
        run, f"query_id {kind}, chunk_id string, doc_id string, score double")


def in_blocks(postings: DataFrame, blocks: int) -> DataFrame:
    """Postings with the block of their document; chunks of a document stay together."""
    return postings.withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))


def block_maxima(postings: DataFrame) -> DataFrame:
    """(term, block, max_tf, min_len): what a term can add at most inside a block."""
    return postings.groupBy("term", "block").agg(
        F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))


def block_max_top_k(
    postings: DataFrame,
    maxima: DataFrame,
    frequencies: DataFrame,
    totals: DataFrame,
    wanted: DataFrame,
    small: bool,
    limit: int,
    rounds: tuple[int, ...] = (4, 32),
    k1: float = settings.BM25_K1,
    b: float = settings.BM25_B,
    read: list[int] | None = None,
) -> DataFrame:
    """The best `limit` chunks per query, as `top_k(score(...))`, from fewer postings.

    `postings` and `maxima` have blocks. The maxima of its terms bound what any chunk of a
    block can score for a query. Blocks are taken by descending bound, in rounds that end at
    the given ranks; after each one the limit-th best score so far is a threshold, and a
    block whose bound lies below it is not looked at. The last round takes what is left,
    so nothing is missed. `read`, if given, gets the number of postings of every round.
    """
    weights, avg_len = _weights(frequencies, totals, wanted, small)
    weights = checkpointed(weights)
    terms = join_small(maxima, weights, ["term"], F.col("block"), small).withColumn(
        "_most", _part(F.col("max_tf"), F.col("min_len"), avg_len, k1, b))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = checkpointed(terms.groupBy("query_id", "block").agg(
        F.sum("_most").alias("bound")).withColumn("_order", F.row_number().over(order)))
    best, after = None, 0
    for upto in (*rounds, None):
        blocks = bounds.filter(F.col("_order") > after)
        if upto is not None:
            blocks = blocks.filter(F.col("_order") <= upto)
        if best is not None:
            # Sums of doubles differ in their last digits with their order.
            least = best.groupBy("query_id").agg(
                F.when(F.count("*") >= limit, F.min("score") - 1e-6).alias("_least"))
            blocks = blocks.join(least, "query_id", "left").filter(
                F.col("_least").isNull() | (F.col("bound") >= F.col("_least")))
        wanted_blocks = blocks.select("query_id", "block").join(
            weights, "query_id").select("term", "block", "query_id", "_idf")
        # At most one row per query, block and term; a key holds the postings of a block.
        matched = postings.join(wanted_blocks, ["term", "block"])
        if read is not None:
            read.append(postings.join(
                wanted_blocks.select("term", "block").distinct(), ["term", "block"],
                "left_semi").count())
        scores = matched.groupBy("query_id", "chunk_id", "doc_id").agg(stable_score(F.sum(
            _part(F.col("tf"), F.col("len"), avg_len, k1, b))).alias("score"))
        found = top_k(scores, limit)
        if best is not None:
            found = top_k(best.drop("rank").unionByName(found.drop("rank")), limit)
        best, after = checkpointed(found), upto
    return best
