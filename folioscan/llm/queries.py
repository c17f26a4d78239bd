"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import (
    byte_bpe, decontaminate, golay, hmm, jaccard, merkle, repeats, secrets, token_counts, topk,
    toxicity, vector_codes, warc,
)
from folioscan.llm.common import ascii_lower, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN_LIMIT = 4096


def _query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


@_query
def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.find_repeats(table(spark, sf_dir, "documents")))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
        limit=TOKEN_LIMIT,
    )


@_query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


# Base 32 of a SHA-1: every five hex digits make four letters.
ORACLES["op5_warc"] = """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS n,
        first(page_id) OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS first_page
      FROM p)
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
      list_aggregate(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER)
              >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
      CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN n > 1 THEN first_page END AS refers_to
    FROM numbered"""


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


ORACLES["op6_secrets"] = secrets.oracle()


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


ORACLES["op7_jaccard_join"] = r"""
    WITH RECURSIVE split AS (
      SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
      FROM documents),
    grams AS (
      SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i
            FROM split WHERE len(words) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS overlap
      FROM grams AS x JOIN grams AS y USING (gram) WHERE x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id),
    links AS (
      SELECT a, b FROM shared JOIN sizes AS x ON a = x.doc_id JOIN sizes AS y ON b = y.doc_id
      WHERE 100 * overlap >= 75 * (x.n + y.n - overlap)),
    reach AS (
      SELECT doc_id AS a, doc_id AS b FROM documents
      UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id
    FROM documents AS d LEFT JOIN sizes USING (doc_id) JOIN reach ON d.doc_id = reach.a
    GROUP BY d.doc_id, n"""


@_query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@_query
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op9_exact_topk"] = """
    WITH v AS (
      SELECT row_number() OVER () AS n, vec_id,
        list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.n, q.vec_id AS query_id, v.vec_id,
        CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.n <> v.n WHERE q.vec_id % 50 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank
      FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rejected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.components(table(spark, sf_dir, "documents"))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


ORACLES["op12_vector_codes"] = vector_codes.oracle()


@_query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Tampering lower-cases A-Z in the text of every third document, by CRC-32 of its id.
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    lowered = F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), changes={"text": lowered})
    return merkle.digests(found)


ORACLES["op13_merkle"] = merkle.oracle()


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
