"""Fixed schemas of the catalog tables and of the search result."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


DOCUMENTS = _schema(
    doc_id=_S, path=_S, filename=_S, ext=_S, source_type=_S, size_bytes=_L,
    created_at=_TS, modified_at=_TS, ingested_at=_TS, title=_S, author=_S,
    page_count=_I, summary=_S, effort=_S, status=_S, source=_S, source_id=_S,
    source_uri=_S, source_modified=_S, mime_type=_S,
)

CHUNKS = _schema(
    chunk_id=_S, doc_id=_S, ordinal=_I, text=_S, locator=_S, token_estimate=_I,
)

CHUNK_EMBEDDINGS = T.StructType([
    T.StructField("chunk_id", _S),
    T.StructField("doc_id", _S),
    T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False)),
])

CATALOG_META = _schema(key=_S, value=_S)
DOC_METADATA = _schema(doc_id=_S, key=_S, value=_S)
TAGS = _schema(doc_id=_S, tag=_S)

# One row per (chunk, term). `len` repeats the chunk's token count so that
# scoring needs no second join.
POSTINGS = _schema(term=_S, chunk_id=_S, doc_id=_S, tf=_I, len=_I)

# Per-part partial sums; the corpus figure is the sum over parts.
TERM_STATS = _schema(term=_S, df=_L)
CORPUS_STATS = _schema(n_chunks=_L, total_len=_L)

LISTING = _schema(
    local_path=_S, source=_S, source_id=_S, source_uri=_S, source_modified=_S,
    mime_type=_S, filename=_S, doc_id=_S,
)

RESULT_COLUMNS = [
    "doc_id", "filename", "source_type", "source_uri", "summary",
    "chunk_id", "locator", "text", "score",
]

# The tables partitioned by a hash of doc_id, with their row schema.
DOCUMENT_TABLES = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "chunk_embeddings": CHUNK_EMBEDDINGS,
    "doc_metadata": DOC_METADATA,
    "tags": TAGS,
    "postings": POSTINGS,
    "term_stats": TERM_STATS,
    "corpus_stats": CORPUS_STATS,
}
