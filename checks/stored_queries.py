"""Search over a stored catalog: index, vectors and results all read from its tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from checks import relations as r
from checks import retrieval_queries as rq
from checks import sql as q
from checks.catalog_queries import WORDS
from checks.registry import check
from folioscan import schemas
from folioscan.operators.joins import with_key
from folioscan.plans.backfill import backfill
from folioscan.plans.ingest import ingest_folder, store_extracted
from folioscan.plans.search import search
from folioscan.sources.catalog import Catalog
from folioscan.sources.files import REJECTS, Extracted
from folioscan.sources.shared import new_folder
from folioscan.streaming.incremental import ingest_stream


def _ingest(catalog, documents, chunks):
    spark = catalog.spark
    listing = documents.select(
        "doc_id", F.col("source_uri").alias("local_path"), "source", "source_id", "source_uri",
        "source_modified", F.lit(None).cast("string").alias("mime_type"), "filename", "ext",
        "source_type", F.length("text").cast("bigint").alias("size_bytes"),
        F.lit(None).cast("timestamp_ntz").alias("modified_at"),
    )
    found = Extracted(
        info=documents.select(
            "doc_id", "title", F.lit(None).cast("string").alias("author"),
            F.lit(None).cast("int").alias("page_count"),
        ),
        chunks=chunks,
        metadata=spark.createDataFrame([], schemas.DOC_METADATA),
        rejects=spark.createDataFrame([], REJECTS),
    )
    return store_extracted(
        catalog, listing, found, effort="low", enrich=True, keep_history=False, stemmer=None,
        summarise=None, tag=None,
    )


@lru_cache
def _stored_catalog(spark, sf_dir):
    """All documents ingested, then every labelled one ingested once more."""
    catalog = Catalog(spark, new_folder(spark, "catalog"), parts=4)
    catalog.set_setting("stemmer", "none")
    documents, chunks = r.documents(spark, sf_dir), r.chunks(spark, sf_dir)
    _ingest(catalog, documents, chunks)
    labelled = r.label_tags(spark, sf_dir).select("doc_id").distinct()
    _ingest(catalog, *(with_key(rows, labelled, "doc_id") for rows in (documents, chunks)))
    return catalog


def _order_files(spark, sf_dir):
    """Orders as one delimited file per status, with a header line."""
    path = new_folder(spark, "orders")
    r.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("folder"), "o_orderkey", "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
    ).repartition("folder").sortWithinPartitions("folder", "o_orderkey").write.partitionBy(
        "folder").option("header", "true").csv(path)
    return path


def _ingested(catalog):
    """Chunks by the folder of their file, and whether ids follow from path and time."""
    documents = catalog.table("documents").select(
        "doc_id", F.regexp_extract("path", "folder=([^/]*)", 1).alias("folder"), "page_count",
        "source_type", (F.col("doc_id") == F.substring(F.sha1(F.concat(
            "path", F.lit("|"), F.unix_micros(F.col("modified_at").cast("timestamp")).cast(
                "string"))), 1, 16)).alias("id_follows"))
    return documents.join(catalog.table("chunks"), "doc_id").select(
        "folder", "source_type", "page_count", "id_follows", "ordinal", "locator", "text")


_ORDER_FILES = """SELECT o_orderstatus AS folder, 'csv' AS source_type, CAST(page_count AS INT)
    AS page_count, true AS id_follows, ordinal,
  'rows ' || (min(row_no) + 1) || '-' || (max(row_no) + 1) AS locator,
  'o_orderkey,o_orderstatus,o_orderpriority' || chr(10)
    || string_agg(line, chr(10) ORDER BY row_no) AS text
FROM (SELECT *, CAST(row_no // 50 AS INT) AS ordinal,
        o_orderkey || ',' || o_orderstatus || ',' || coalesce(nullif(o_orderpriority, '5-LOW'), '')
        AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1
              AS row_no, count(*) OVER (PARTITION BY o_orderstatus) AS page_count FROM orders))
GROUP BY o_orderstatus, page_count, ordinal"""


@check(_ORDER_FILES)
def ingested_files(spark, sf_dir):
    """A folder listed, extracted and stored, then once more without anything to do."""
    path = _order_files(spark, sf_dir)
    catalog = Catalog(spark, new_folder(spark, "catalog"), parts=4)
    assert ingest_folder(catalog, path, effort="low").failed == 0
    assert ingest_folder(catalog, path, effort="low").documents == 0
    return _ingested(catalog)


@check(_ORDER_FILES)
def streamed_ingest(spark, sf_dir):
    """The same folder as a stream that is started twice."""
    path = _order_files(spark, sf_dir)
    catalog = Catalog(spark, new_folder(spark, "catalog"), parts=4)
    checkpoint = new_folder(spark, "stream")
    for _ in range(2):
        ingest_stream(catalog, path, checkpoint, effort="low").awaitTermination()
    return _ingested(catalog)


@check(q.select(
    f"{rq._HYBRID} FROM fused JOIN chunks USING (chunk_id, doc_id) JOIN docs d USING (doc_id)",
    rq._LISTS, q.fused(rq.LIMIT)))
def stored_hybrid_search(spark, sf_dir):
    catalog = _stored_catalog(spark, sf_dir)
    backfill(catalog, parts_per_commit=2)
    found, mode = search(catalog, r.queries(spark, sf_dir), limit=rq.LIMIT)
    assert mode == "hybrid"
    return found.withColumn("score", F.round("score", 12))


@check(q.select("""SELECT term, df, (SELECT n_chunks FROM totals) AS n_chunks,
  CAST((SELECT total_len FROM totals) AS BIGINT) AS total_len FROM frequencies""", q.POSTINGS))
def stored_statistics(spark, sf_dir):
    """Statistics summed over the parts after documents were replaced."""
    catalog = _stored_catalog(spark, sf_dir)
    n, length = catalog.table("corpus_stats").agg(F.sum("n_chunks"), F.sum("total_len")).first()
    return catalog.table("term_stats").groupBy("term").agg(F.sum("df").alias("df")).select(
        "term", "df", F.lit(n).alias("n_chunks"), F.lit(length).alias("total_len")
    )


@check(q.select("SELECT doc_id, tag FROM keyword_tags", WORDS))
def stored_tags(spark, sf_dir):
    return _stored_catalog(spark, sf_dir).table("tags")
