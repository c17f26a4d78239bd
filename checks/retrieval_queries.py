"""Lexical, dense and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import relations as r
from checks import sql as q
from checks.registry import check
from folioscan.functions import terms as tm
from folioscan.functions import vectors as vx
from folioscan.operators import dense, fusion, lexical, model_calls, results
from folioscan.operators.filters import Filters, matching_documents, restrict
from folioscan.operators.joins import is_small
from folioscan.operators.ranking import first_k, top_k
from folioscan.plans.search import lexical_scores
from folioscan.sources.shared import checkpointed

LIMIT = 10
POOL = 40


@check(q.select("""SELECT chunk_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2""",
                q.POSTINGS))
def lexical_tokens(spark, sf_dir):
    return r.chunks(spark, sf_dir).select(
        "chunk_id", F.explode(tm.lexical_tokens(F.col("text"))).alias("term")
    ).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


@check(q.select("SELECT * FROM postings", q.POSTINGS))
def postings(spark, sf_dir):
    return lexical.build_postings(r.chunks(spark, sf_dir), stemmer=None)


@check(q.select("SELECT * FROM frequencies", q.POSTINGS))
def document_frequencies(spark, sf_dir):
    return lexical.document_frequencies(
        lexical.build_postings(r.chunks(spark, sf_dir), stemmer=None)
    )


@check(q.select("SELECT n_chunks, CAST(total_len AS BIGINT) AS total_len FROM totals", q.POSTINGS))
def corpus_totals(spark, sf_dir):
    return lexical.corpus_totals(r.chunks(spark, sf_dir), stemmer=None)


@check(q.select("""SELECT stem AS term, chunk_id, doc_id, CAST(count(*) AS INT) AS tf,
  CAST(any_value(len) AS INT) AS len FROM tokens JOIN stems USING (term) JOIN lengths USING (chunk_id)
  GROUP BY 1, 2, 3""", q.POSTINGS, q.PORTER))
def stemmed_postings(spark, sf_dir):
    return lexical.build_postings(r.chunks(spark, sf_dir), stemmer="porter")


def _lexical_scores(spark, sf_dir, wanted=None, best=None):
    allowed = matching_documents(
        r.documents(spark, sf_dir), r.label_tags(spark, sf_dir), wanted
    ) if wanted else None
    return lexical_scores(r.chunks(spark, sf_dir), r.queries(spark, sf_dir), None, allowed, best)


def _lexical_ranked(spark, sf_dir, k, wanted=None):
    return top_k(_lexical_scores(spark, sf_dir, wanted, k), k)


@check(q.select("SELECT query_id, chunk_id, doc_id, round(score, 6) AS score FROM lexical_scores",
                q.QUERIES, q.POSTINGS, q.SCORES))
def bm25_scores(spark, sf_dir):
    return _lexical_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@check(q.select(
    "SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank "
    "FROM lexical", q.QUERIES, q.POSTINGS, q.SCORES, q.ranked("lexical_scores", "lexical", LIMIT)))
def bm25_top_k(spark, sf_dir):
    return _lexical_ranked(spark, sf_dir, LIMIT).withColumn("score", F.round("score", 6))


@check(q.select(
    "SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank "
    "FROM lexical", q.QUERIES, q.POSTINGS, q.SCORES, q.ranked("lexical_scores", "lexical", LIMIT)))
def bm25_block_max(spark, sf_dir):
    """The best chunks from postings in blocks with their maxima."""
    chunks = r.chunks(spark, sf_dir)
    wanted = lexical.query_terms(r.queries(spark, sf_dir), stemmer=None)
    small = is_small(wanted)
    blocks = max(1, chunks.select("doc_id").distinct().count() // 8)
    # All that the search reads: postings, maxima and frequencies of the terms asked for.
    matching = lexical.matching_postings(lexical.build_postings(chunks, None), wanted, small)
    postings = checkpointed(lexical.in_blocks(matching, blocks))
    best = lexical.block_max_top_k(
        postings, checkpointed(lexical.block_maxima(postings)),
        lexical.document_frequencies(postings), lexical.corpus_totals(chunks, None), wanted,
        small, LIMIT)
    return best.withColumn("score", F.round("score", 6))


_BEST_WORD = """queries AS (
  SELECT 0 AS query_id, string_agg(term, ' ') AS text FROM (
    SELECT term FROM frequencies ORDER BY df DESC, term LIMIT 3))"""


def _frequent_words(frequencies):
    """A query of the three most frequent terms: the worst case for hot terms."""
    return frequencies.orderBy(F.desc("df"), "term").limit(3).agg(
        F.concat_ws(" ", F.collect_list("term")).alias("text")
    ).withColumn("query_id", F.lit(0))


_RESULT = """SELECT doc_id, filename, source_type, source_uri, summary, chunk_id, locator, text,
  round(score, 6) AS score, CAST(rank AS INT) AS rank, query_id"""


@check(q.select(
    f"{_RESULT} FROM lexical JOIN chunks USING (chunk_id, doc_id) JOIN docs d USING (doc_id)"
    .replace("text,", "chunks.text,", 1),
    q.POSTINGS, _BEST_WORD, q.SCORES, q.ranked("lexical_scores", "lexical", LIMIT)))
def bm25_search(spark, sf_dir):
    """Result rows of a query made of the corpus's three most frequent terms."""
    chunks = r.chunks(spark, sf_dir)
    frequencies = lexical.document_frequencies(lexical.build_postings(chunks, stemmer=None))
    query = checkpointed(_frequent_words(frequencies))
    scores = lexical_scores(chunks, query, stemmer=None, best=LIMIT)
    return results.result_rows(
        top_k(scores, LIMIT), chunks, r.documents(spark, sf_dir), LIMIT
    ).withColumn("score", F.round("score", 6))


@check(q.select(
    "SELECT filename, locator, chunks.text, round(score, 6) AS score "
    "FROM lexical JOIN chunks USING (chunk_id, doc_id) JOIN docs d USING (doc_id)",
    q.QUERIES, q.POSTINGS, q.SCORES, q.ranked("lexical_scores", "lexical", 3)))
def short_results(spark, sf_dir):
    chunks = r.chunks(spark, sf_dir)
    ranked = _lexical_ranked(spark, sf_dir, 3)
    return results.short_rows(
        results.result_rows(ranked, chunks, r.documents(spark, sf_dir))
    ).withColumn("score", F.round("score", 6))


WANTED = Filters.of(types=["text", "json"], tags=["quality-1", "toxic-1"], source="local")
_FILTERS = {
    "types": "source_type IN ('text', 'json')",
    "source": "source = 'local'",
    "tags": "doc_id IN (SELECT doc_id FROM label_tags WHERE tag IN ('quality-1', 'toxic-1'))",
}
_ALL_FILTERS = " AND ".join(_FILTERS.values())


def _found(spark, sf_dir, wanted):
    return matching_documents(
        r.documents(spark, sf_dir), r.label_tags(spark, sf_dir), wanted
    ).select("doc_id", "filename")


@check(f"WITH {q.DOCS} SELECT doc_id, filename FROM docs WHERE {_FILTERS['types']}")
def filter_by_type(spark, sf_dir):
    return _found(spark, sf_dir, Filters.of(types=WANTED.types))


@check(f"WITH {q.DOCS} SELECT doc_id, filename FROM docs WHERE {_FILTERS['source']}")
def filter_by_source(spark, sf_dir):
    return _found(spark, sf_dir, Filters.of(source=WANTED.source))


@check(f"WITH {q.DOCS}, {q.TAGS} SELECT doc_id, filename FROM docs WHERE {_FILTERS['tags']}")
def filter_by_tag(spark, sf_dir):
    return _found(spark, sf_dir, Filters.of(tags=WANTED.tags))


@check(f"WITH {q.DOCS}, {q.TAGS} SELECT doc_id, filename FROM docs WHERE {_ALL_FILTERS}")
def filter_by_all(spark, sf_dir):
    return _found(spark, sf_dir, WANTED)


@check(q.select(
    "SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank "
    "FROM lexical", q.TAGS, q.QUERIES, q.POSTINGS, q.SCORES,
    f"""kept AS (SELECT * FROM lexical_scores WHERE doc_id IN (
      SELECT doc_id FROM docs WHERE {_ALL_FILTERS}))""", q.ranked("kept", "lexical", LIMIT)))
def bm25_filtered(spark, sf_dir):
    return _lexical_ranked(spark, sf_dir, LIMIT, WANTED).withColumn("score", F.round("score", 6))


@check(q.select("SELECT chunk_id, doc_id, bucket, v FROM chunk_vecs JOIN chunks USING (chunk_id)",
                q.hash_vectors("chunks", "chunk_vecs", "chunk_id")))
def hashing_embeddings(spark, sf_dir):
    """Non-zero entries of the hashing vectors, in stored precision."""
    return r.chunk_vectors(spark, sf_dir).select(
        "chunk_id", "doc_id", F.posexplode(vx.as_double(F.col("embedding"))).alias("bucket", "v")
    ).filter(F.col("v") != 0)


def _python_embedder(model):
    """The hashing embedder as a caller's model would be written."""
    import hashlib
    import math
    import re

    def embed(texts):
        out = []
        for text in texts:
            vector = [0.0] * 64
            for token in re.findall("[a-z0-9]+", text.lower()):
                vector[int(hashlib.sha1(token.encode()).hexdigest()[:8], 16) % 64] += 1
            size = math.sqrt(sum(v * v for v in vector))
            out.append([v / size for v in vector] if size else vector)
        return out

    return embed


@check(q.select("SELECT chunk_id, doc_id, bucket, v FROM chunk_vecs JOIN chunks USING (chunk_id)",
                q.hash_vectors("chunks", "chunk_vecs", "chunk_id")))
def model_embeddings(spark, sf_dir):
    """The same vectors from a Python model called in batches."""
    embedded = model_calls.apply_model(
        r.chunks(spark, sf_dir).select("chunk_id", "doc_id", "text"),
        "text", "embedding", "array<float>", _python_embedder, "hashing",
    )
    return embedded.select(
        "chunk_id", "doc_id", F.posexplode(vx.as_double(F.col("embedding"))).alias("bucket", "v")
    ).filter(F.col("v") != 0)


@check(f"""WITH {q.QUERIES}, {q.hash_vectors("queries", "vecs", "query_id")}
SELECT query_id, bucket, v FROM vecs""")
def query_embeddings(spark, sf_dir):
    return r.embedded(r.queries(spark, sf_dir), "query_id").select(
        "query_id", F.posexplode(vx.as_double(F.col("embedding"))).alias("bucket", "v")
    ).filter(F.col("v") != 0)


_STORED = """stored AS (
  SELECT printf('v-%05d', CAST(vec_id AS INT)) AS chunk_id, 'label-' || label AS doc_id,
         CAST(embedding AS DOUBLE[]) AS v, vec_id FROM embeddings)"""


@check(f"""WITH {_STORED}, vector_query AS (SELECT v AS qv FROM stored ORDER BY vec_id LIMIT 1)
SELECT chunk_id, doc_id, round(list_cosine_similarity(v, qv), 9) AS score
FROM stored, vector_query ORDER BY score DESC, chunk_id LIMIT {LIMIT}""")
def cosine_search(spark, sf_dir):
    """The nearest neighbours of the first stored vector."""
    vectors = r.plain_vectors(spark, sf_dir)
    first = vectors.orderBy("chunk_id").first()["embedding"]
    return first_k(dense.score_one(vectors, first), LIMIT)


@check(f"""WITH {_STORED}, dense_scores AS (
  SELECT b.vec_id AS query_id, a.chunk_id, a.doc_id,
         round(list_cosine_similarity(a.v, b.v), 9) AS score FROM stored a, stored b),
{q.ranked("dense_scores", "dense", LIMIT)}
SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dense""")
def cosine_all_vectors(spark, sf_dir):
    """Nearest neighbours of every stored vector, in blocks of queries."""
    vectors = r.plain_vectors(spark, sf_dir)
    queries = r.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )
    return dense.search_batch(vectors, queries, LIMIT, per_block=300).withColumn(
        "score", F.round("score", 6)
    )


def _dense_ranked(spark, sf_dir, k, wanted=None):
    vectors = r.chunk_vectors(spark, sf_dir)
    if wanted:
        vectors = restrict(
            vectors, r.documents(spark, sf_dir), r.label_tags(spark, sf_dir), wanted
        )
    return dense.search_batch(vectors, r.embedded(r.queries(spark, sf_dir), "query_id"), k)


@check(q.select(
    "SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank "
    "FROM dense", q.QUERIES, q.DENSE, q.ranked("dense_scores", "dense", LIMIT)))
def vector_top_k(spark, sf_dir):
    return _dense_ranked(spark, sf_dir, LIMIT).withColumn("score", F.round("score", 6))


@check(q.select(
    "SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank "
    "FROM dense", q.TAGS, q.QUERIES, q.DENSE,
    f"""kept AS (SELECT * FROM dense_scores WHERE doc_id IN (
      SELECT doc_id FROM docs WHERE {_ALL_FILTERS}))""", q.ranked("kept", "dense", LIMIT)))
def vector_filtered(spark, sf_dir):
    return _dense_ranked(spark, sf_dir, LIMIT, WANTED).withColumn("score", F.round("score", 6))


_LISTS = ",\n".join([
    q.QUERIES, q.POSTINGS, q.SCORES, q.DENSE,
    q.ranked("lexical_scores", "lexical", POOL), q.ranked("dense_scores", "dense", POOL),
])


def _lists(spark, sf_dir):
    pool = fusion.pool_size(LIMIT)
    return _lexical_ranked(spark, sf_dir, pool), _dense_ranked(spark, sf_dir, pool)


@check(q.select("""SELECT query_id, chunk_id, doc_id, CAST(rank AS INT) AS rank, list_no
                   FROM both_lists""", _LISTS, q.fused(LIMIT)))
def ranked_lists_union(spark, sf_dir):
    return fusion.union_of_lists(*_lists(spark, sf_dir))


@check(q.select("""SELECT query_id, chunk_id, doc_id, round(score, 12) AS score,
                   CAST(rank AS INT) AS rank FROM fused""", _LISTS, q.fused(LIMIT)))
def reciprocal_rank_fusion(spark, sf_dir):
    return fusion.fuse(*_lists(spark, sf_dir), LIMIT).withColumn("score", F.round("score", 12))


_HYBRID = _RESULT.replace("text,", "chunks.text,", 1).replace("score, 6", "score, 12")


@check(q.select(
    f"{_HYBRID} FROM fused JOIN chunks USING (chunk_id, doc_id) JOIN docs d USING (doc_id)",
    _LISTS, q.fused(LIMIT)))
def hybrid_search(spark, sf_dir):
    """Result rows of every benchmark text, both retrievers fused."""
    fused = fusion.fuse(*_lists(spark, sf_dir), LIMIT)
    return results.result_rows(
        fused, r.chunks(spark, sf_dir), r.documents(spark, sf_dir)
    ).withColumn("score", F.round("score", 12))


@check(q.select(
    f"{_HYBRID} FROM fused JOIN chunks USING (chunk_id, doc_id) JOIN docs d USING (doc_id)",
    q.TAGS, _LISTS.replace("FROM lexical_scores", "FROM kept_lexical")
    .replace("FROM dense_scores", "FROM kept_dense").replace(
        "lexical AS (\n", f"""kept_lexical AS (SELECT * FROM lexical_scores WHERE doc_id IN (
      SELECT doc_id FROM docs WHERE {_ALL_FILTERS})),
kept_dense AS (SELECT * FROM dense_scores WHERE doc_id IN (
      SELECT doc_id FROM docs WHERE {_ALL_FILTERS})),
lexical AS (\n""", 1), q.fused(LIMIT)))
def hybrid_filtered(spark, sf_dir):
    pool = fusion.pool_size(LIMIT)
    words = _lexical_ranked(spark, sf_dir, pool, WANTED)
    fused = fusion.fuse(words, _dense_ranked(spark, sf_dir, pool, WANTED), LIMIT)
    return results.result_rows(
        fused, r.chunks(spark, sf_dir), r.documents(spark, sf_dir)
    ).withColumn("score", F.round("score", 12))


@check(q.select(
    f"""SELECT query_id, CAST(rank + 1 AS INT) AS place,
  printf('%d. [%.4f] %s (%s, %s)', rank + 1, score, filename, source_type, locator)
  || chr(10) || '   uri: ' || source_uri || chr(10) || '   '
  || substr(regexp_replace({q.strip("chunks.text")}, '[{q.WHITESPACE_CLASS}]+', ' ', 'g'), 1, 240)
  AS line FROM fused JOIN chunks USING (chunk_id, doc_id) JOIN docs d USING (doc_id)""",
    _LISTS, q.fused(5)))
def formatted_results(spark, sf_dir):
    fused = fusion.fuse(*_lists(spark, sf_dir), 5)
    rows = results.result_rows(fused, r.chunks(spark, sf_dir), r.documents(spark, sf_dir))
    return rows.select(
        "query_id", (F.col("rank") + 1).alias("place"), results.result_line().alias("line")
    )
