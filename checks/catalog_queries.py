"""Joins, aggregates, updates, tags, manifest, listing and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import relations as r
from checks import sql as q
from checks.registry import check
from folioscan import schemas, settings
from folioscan.functions import delimited as dx
from folioscan.functions.text import WHITESPACE_CLASS
from folioscan.operators import (
    dense, filters, listing, manifest, model_calls, prompts, tags, upserts,
)
from folioscan.operators.running import running_before
from folioscan.plans.ingest import ingest_totals, superseded
from folioscan.sources.catalog import Catalog
from folioscan.sources.shared import new_folder
from folioscan.streaming.incremental import backfill_stream

# -- tags ---------------------------------------------------------------------

WORDS = f"""words AS (
  SELECT doc_id, ordinal, lower(w) AS term, pos FROM (
    SELECT doc_id, ordinal, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}')) AS w,
           generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), 1) AS pos
    FROM chunks) WHERE lower(w) NOT IN ({q.STOP})),
counted AS (
  SELECT doc_id, term, count(*) AS n, min(ordinal * 1000000 + pos) AS first
  FROM words GROUP BY 1, 2),
keyword_tags AS (
  SELECT doc_id, term AS tag, tag_rank FROM (SELECT *, row_number() OVER (
    PARTITION BY doc_id ORDER BY n DESC, first) AS tag_rank FROM counted) WHERE tag_rank <= 6)"""


@check(q.select("SELECT doc_id, term, n FROM counted", WORDS))
def term_frequencies(spark, sf_dir):
    return tags.term_frequencies(r.chunks(spark, sf_dir)).select("doc_id", "term", "n")


@check(q.select("SELECT doc_id, tag, CAST(tag_rank AS INT) AS tag_rank FROM keyword_tags", WORDS))
def keyword_tags(spark, sf_dir):
    return tags.keyword_tags(r.chunks(spark, sf_dir))


@check(q.select("SELECT doc_id, tag FROM keyword_tags", WORDS))
def enrichment_low_tier(spark, sf_dir):
    return tags.enrich(r.chunks(spark, sf_dir), "low")[1]


@check(f"""SELECT DISTINCT conv_id, turn, tag FROM (
  SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(text, ','),
    lambda t: {q.strip("lower(t)")}), lambda t: t <> '')[1:8]) AS tag FROM conversations)""")
def normalised_tags(spark, sf_dir):
    return r.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(F.array_distinct(
            tags.normalised_tags(F.split("text", ",")))).alias("tag")
    )


def _first_words(model):
    """A caller's tagging model: the first three words; fails on texts with `ü`."""

    def call(texts):
        if any("ü" in t for t in texts):
            raise ValueError("cannot read this")
        return [t.split()[:3] for t in texts]

    return call


def _first_line(model):
    """A caller's summary model."""
    return lambda texts: [t.split("\n")[0] for t in texts]


@check(q.select(f"""SELECT doc_id, tag FROM keyword_tags WHERE doc_id IN (
    SELECT doc_id FROM whole WHERE contains(substr(text, 1, 6000), 'ü'))
  UNION ALL
  SELECT DISTINCT doc_id, lower(unnest(list_filter(regexp_split_to_array(
    {q.strip("substr(text, 1, 6000)")}, '[{WHITESPACE_CLASS}]+'), lambda t: t <> '')[1:3]))
  FROM whole WHERE NOT contains(substr(text, 1, 6000), 'ü')""", WORDS,
    """whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text
                 FROM chunks GROUP BY 1)"""))
def enrichment_high_tier(spark, sf_dir):
    """Tags from a model, keywords where it fails."""
    return tags.enrich(r.chunks(spark, sf_dir), "high", _first_line, _first_words)[1]


@check(q.select(f"""SELECT doc_id, {q.strip("split_part(substr(text, 1, 6000), chr(10), 1)")} AS summary
  FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text
        FROM chunks GROUP BY 1)"""))
def model_summaries(spark, sf_dir):
    return tags.enrich(r.chunks(spark, sf_dir), "high", _first_line, _first_words)[0]


# -- manifest -----------------------------------------------------------------

_STATUS = """stated AS (
  SELECT docs.*, CASE WHEN toxic = 1 THEN 'archived' ELSE 'active' END AS status
  FROM docs LEFT JOIN labels ON labels.doc_id = docs.number)"""

_ENTRIES = """entries AS (
  SELECT doc_id, filename, source_type, title, summary, source_uri,
         coalesce(n_chunks, 0) AS n_chunks, tags
  FROM stated LEFT JOIN (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM label_tags GROUP BY 1)
    USING (doc_id) WHERE status = 'active')"""


def _stated(spark, sf_dir):
    """Documents with a status; toxic ones are archived."""
    labels = r.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), "toxic")
    return r.documents(spark, sf_dir).drop("text").join(labels, "number", "left").withColumn(
        "status", F.when(F.col("toxic") == 1, "archived").otherwise("active")
    )


@check(f"WITH {q.DOCS}, {_STATUS} SELECT doc_id, status FROM stated WHERE status = 'active'")
def active_documents(spark, sf_dir):
    return filters.active(_stated(spark, sf_dir)).select("doc_id", "status")


def _entries(spark, sf_dir):
    return manifest.manifest_entries(
        _stated(spark, sf_dir), r.chunks(spark, sf_dir), r.label_tags(spark, sf_dir)
    )


@check(q.select("SELECT * FROM entries", q.TAGS, _STATUS, _ENTRIES))
def manifest_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


_BLOCK = """'### ' || coalesce(nullif(title, ''), filename) || chr(10) || '- `' || filename || '` · '
  || n_chunks || ' chunks' || CASE WHEN tags <> '' THEN chr(10) || '- tags: ' || tags ELSE '' END
  || chr(10) || '- uri: ' || source_uri || chr(10)"""


@check(q.select(f"""SELECT coalesce(source_type, 'other') AS section, 1 AS kind, filename, doc_id,
         {_BLOCK} AS block FROM entries
  UNION ALL SELECT DISTINCT coalesce(source_type, 'other'), 0, NULL, NULL,
         '## ' || coalesce(source_type, 'other') || chr(10) FROM entries""",
    q.TAGS, _STATUS, _ENTRIES))
def manifest_blocks(spark, sf_dir):
    return manifest.manifest_blocks(_entries(spark, sf_dir))


@check(q.select(f"""SELECT unnest(string_split({_BLOCK}, chr(10))) AS line FROM entries
  UNION ALL SELECT unnest(['## ' || source_type, '']) FROM (SELECT DISTINCT source_type FROM entries)
  UNION ALL SELECT unnest(['# Index', '', '_Descriptive index of the catalog''s resources._',
    '_Updated now · ' || (SELECT count(*) FROM entries) || ' documents._', '',
    'Browse this file first. To get the text of an entry, search the catalog.', ''])""",
    q.TAGS, _STATUS, _ENTRIES))
def manifest_file(spark, sf_dir):
    """The manifest written as text and read back."""
    path = new_folder(spark, "manifest")
    manifest.write_manifest(_entries(spark, sf_dir), path, "Index", "now")
    return spark.read.text(path).withColumnRenamed("value", "line")


# -- aggregates ---------------------------------------------------------------


@check("SELECT count(*) AS n_vectors, count_if(len(embedding) <> 64) AS n_wrong FROM embeddings")
def vector_dimensions(spark, sf_dir):
    return dense.dimension_check(r.plain_vectors(spark, sf_dir), 64)


@check(q.select("SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY 1"))
def chunks_per_document(spark, sf_dir):
    return r.chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@check(f"""WITH {q.DOCS}, {q.TAGS}
SELECT doc_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM label_tags GROUP BY 1""")
def tags_per_document(spark, sf_dir):
    return r.label_tags(spark, sf_dir).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags")
    )


@check(f"""WITH {q.DOCS} SELECT source_type, count(*) AS n, max(title) AS last_title
           FROM docs GROUP BY 1""")
def catalog_overview(spark, sf_dir):
    return r.documents(spark, sf_dir).groupBy("source_type").agg(
        F.count("*").alias("n"), F.max("title").alias("last_title")
    )


@check(q.select("""SELECT (SELECT count(*) FROM docs) AS documents,
  (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM docs WHERE ext = '.json') AS failed"""))
def ingest_counts(spark, sf_dir):
    documents = r.documents(spark, sf_dir)
    return ingest_totals(
        documents, r.chunks(spark, sf_dir), documents.filter(F.col("ext") == ".json")
    )


@check("""SELECT o_orderkey, o_orderpriority, row_number() OVER w - 1 AS row_no,
  CAST(coalesce(sum(floor(o_totalprice)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
       AS BIGINT) AS value_before
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)""")
def running_totals(spark, sf_dir):
    """Numbering and running sums of a table whose keys are a few very large groups."""
    rows = r.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.floor("o_totalprice").alias("value")
    )
    numbered = running_before(rows, ["o_orderpriority"], "o_orderkey", name="row_no")
    return running_before(
        numbered, ["o_orderpriority"], "o_orderkey", weight=F.col("value"), name="value_before"
    ).drop("value")


# -- keyed updates ------------------------------------------------------------

_CATALOG_COLUMNS = [
    "doc_id", "filename", "source_type", "title", "summary", "source", "source_id",
    "source_modified", "status",
]


def _old(spark, sf_dir):
    """Stored documents: every one has a summary, and its second version is missing."""
    return upserts.complete_documents(
        r.documents(spark, sf_dir)
        .withColumn("summary", F.concat(F.lit("about "), "filename"))
    )


def _new(spark, sf_dir):
    """Arriving rows for labelled documents, and as many new documents."""
    labels = r.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), "quality")
    changed = r.documents(spark, sf_dir).join(labels, "number").withColumn(
        "title", F.concat(F.lit("quality "), F.col("quality").cast("string"))
    )
    added = changed.withColumn("doc_id", F.concat(F.lit("new-"), "doc_id"))
    return changed.unionByName(added).select("doc_id", "filename", "title", "source_id", "source")


@check(f"""WITH {q.DOCS}, arriving AS (
  SELECT docs.doc_id, filename, 'quality ' || quality AS title, source_id, source
  FROM docs JOIN labels ON labels.doc_id = number),
new_rows AS (SELECT * FROM arriving UNION ALL SELECT * REPLACE ('new-' || doc_id AS doc_id) FROM arriving)
SELECT doc_id, filename, source_type, title, 'about ' || filename AS summary, source, source_id,
       source_modified, 'active' AS status FROM docs
WHERE doc_id NOT IN (SELECT doc_id FROM new_rows)
UNION ALL
SELECT doc_id, filename, NULL, title, CASE WHEN doc_id NOT LIKE 'new-%' THEN 'about ' || filename END,
       source, source_id, NULL, 'active' FROM new_rows""")
def upsert_documents(spark, sf_dir):
    return upserts.upsert_documents(_old(spark, sf_dir), _new(spark, sf_dir)).select(
        *_CATALOG_COLUMNS
    )


_TOUCHED = "touched AS (SELECT docs.doc_id FROM docs JOIN labels ON labels.doc_id = number)"


def _touched(spark, sf_dir):
    labels = r.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"))
    return r.documents(spark, sf_dir).join(labels, "number").select("doc_id")


@check(q.select("""SELECT * FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM touched)
  UNION ALL SELECT chunk_id, doc_id, ordinal, 'new ' || text, locator, token_estimate FROM chunks
  WHERE ordinal = 0 AND doc_id IN (SELECT doc_id FROM touched)""", _TOUCHED))
def replace_chunks(spark, sf_dir):
    chunks, touched = r.chunks(spark, sf_dir), _touched(spark, sf_dir)
    new = (
        chunks.join(touched, "doc_id", "left_semi").filter(F.col("ordinal") == 0)
        .withColumn("text", F.concat(F.lit("new "), "text"))
    )
    return upserts.replace_by_document(chunks, new, touched)


@check(q.select("""SELECT chunk_id, doc_id FROM chunks
                   WHERE doc_id NOT IN (SELECT doc_id FROM touched)""", _TOUCHED))
def replace_drops_vectors(spark, sf_dir):
    """Vectors of replaced chunks go with them."""
    vectors = r.chunk_vectors(spark, sf_dir)
    return upserts.replace_by_document(
        vectors, vectors.limit(0), _touched(spark, sf_dir)
    ).select("chunk_id", "doc_id")


@check(f"""WITH {q.DOCS} SELECT doc_id, unnest(['ext', 'size', 'author']) AS key,
             unnest([ext, source_modified, NULL]) AS value FROM docs""")
def replace_metadata(spark, sf_dir):
    documents = r.documents(spark, sf_dir)
    old = documents.select("doc_id", F.lit("stale").alias("key"), F.lit("x").alias("value"))
    new = upserts.metadata_rows(documents.select("doc_id", F.create_map(
        F.lit("ext"), "ext", F.lit("size"), "source_modified",
        F.lit("author"), F.lit(None).cast("string"),
    ).alias("metadata")))
    return upserts.replace_by_document(old, new, documents)


@check(f"""WITH {q.DOCS}, {q.TAGS}, {_TOUCHED}
SELECT doc_id, tag FROM label_tags WHERE doc_id NOT IN (SELECT doc_id FROM touched)
UNION ALL SELECT DISTINCT doc_id, unnest([source_type, source, source_type]) AS tag FROM docs
WHERE doc_id IN (SELECT doc_id FROM touched) AND source_type = 'text'""")
def replace_tags(spark, sf_dir):
    """Labelled documents get other tags without repeats, or none at all."""
    touched = _touched(spark, sf_dir)
    documents = r.documents(spark, sf_dir).join(touched, "doc_id", "left_semi")
    new = upserts.tag_rows(documents.filter(F.col("source_type") == "text").select(
        "doc_id", F.array("source_type", "source", "source_type").alias("tags")
    ))
    return upserts.replace_by_document(r.label_tags(spark, sf_dir), new, touched)


@check(f"""WITH {q.DOCS} SELECT docs.doc_id, coalesce('q' || quality, 'about ' || filename) AS summary
           FROM docs LEFT JOIN labels ON labels.doc_id = number""")
def update_summaries(spark, sf_dir):
    labels = r.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), "quality")
    new = r.documents(spark, sf_dir).join(labels, "number").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("summary")
    )
    return upserts.update_summaries(_old(spark, sf_dir), new).select("doc_id", "summary")


_VERSIONS = """versions AS (
  SELECT doc_id, source, CASE WHEN number % 10 = 9 THEN NULL ELSE 'id-' || (number // 3) END AS source_id,
         source_modified, number FROM docs),
latest AS (
  SELECT doc_id, source, source_id, source_modified FROM (
    SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY number DESC, doc_id) AS n
    FROM versions WHERE source_id IS NOT NULL) WHERE n = 1
  UNION ALL SELECT doc_id, source, source_id, source_modified FROM versions WHERE source_id IS NULL)"""


def _versions(spark, sf_dir):
    """Up to three versions per source id, ingested one day after the other."""
    return r.documents(spark, sf_dir).withColumn(
        "source_id", F.when(F.col("number") % 10 != 9, F.concat(
            F.lit("id-"), F.floor(F.col("number") / 3).cast("string")))
    ).withColumn(
        "ingested_at", F.timestamp_seconds(F.col("number") * 86400).cast("timestamp_ntz")
    ).select("doc_id", "source", "source_id", "source_modified", "ingested_at")


@check(f"WITH {q.DOCS}, {_VERSIONS} SELECT * FROM latest")
def latest_versions(spark, sf_dir):
    return upserts.latest_versions(_versions(spark, sf_dir)).drop("ingested_at")


@check(f"""WITH {q.DOCS}, {_VERSIONS}
SELECT DISTINCT a.doc_id FROM versions a JOIN latest b
  ON a.source = b.source AND a.source_id = b.source_id AND a.doc_id <> b.doc_id""")
def superseded_documents(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    return superseded(versions, upserts.latest_versions(versions))


@check(f"""WITH {q.DOCS}, {_VERSIONS}
SELECT source_id, source_modified FROM latest WHERE source = 'gdrive' AND source_id IS NOT NULL""")
def existing_versions(spark, sf_dir):
    return upserts.existing_versions(_versions(spark, sf_dir), "gdrive")


@check(f"""WITH {q.DOCS}, listed AS (
  SELECT source_id, CASE WHEN number % 3 = 0 THEN source_modified || 'x' ELSE source_modified END
    AS source_modified FROM docs)
SELECT * FROM listed WHERE (source_id, source_modified) NOT IN (
  SELECT source_id, source_modified FROM docs WHERE source = 'local')""")
def incremental_skip(spark, sf_dir):
    documents = r.documents(spark, sf_dir)
    listed = documents.select("source_id", F.when(
        F.col("number") % 3 == 0, F.concat("source_modified", F.lit("x"))
    ).otherwise(F.col("source_modified")).alias("source_modified"))
    return upserts.new_or_changed(listed, upserts.existing_versions(
        documents.filter(F.col("source") == "local").withColumn(
            "ingested_at", F.lit(None).cast("timestamp_ntz")), "local"))


@check("""SELECT key, arg_max(value, n) AS value FROM (
  SELECT 'embedding_model' AS key, 'm1' AS value, 0 AS n UNION ALL
  SELECT o_orderpriority, max(o_orderstatus), 0 FROM orders GROUP BY 1 UNION ALL
  SELECT '1-URGENT', 'set', 1) GROUP BY 1""")
def settings_table(spark, sf_dir):
    """One setting per order priority; one is set again, a lock is asked for twice."""
    stored = r.table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("key")
    ).agg(F.max("o_orderstatus").alias("value"))
    changed = upserts.set_meta(stored, "1-URGENT", "set")
    locked = upserts.lock_value(changed, "embedding_model", "m1")
    return upserts.lock_value(locked, "embedding_model", "m2")


@check(q.select("SELECT * FROM chunks"))
def legacy_chunk_table(spark, sf_dir):
    old = r.chunks(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    return upserts.drop_legacy_columns(upserts.drop_legacy_columns(old))


# -- vectors ------------------------------------------------------------------


@check(q.select("""SELECT chunk_id, doc_id, ordinal, text FROM chunks
                   WHERE length(text) % 3 <> 0 OR ordinal > 0"""))
def missing_vectors(spark, sf_dir):
    chunks = r.chunks(spark, sf_dir)
    has = chunks.filter((F.length("text") % 3 == 0) & (F.col("ordinal") == 0))
    return dense.missing(chunks, has.select("chunk_id"))


@check(q.select("""SELECT chunk_id, doc_id, ordinal, text FROM chunks
                   WHERE ordinal > 0 AND doc_id = (SELECT max(doc_id) FROM docs)"""))
def missing_vectors_of_document(spark, sf_dir):
    chunks = r.chunks(spark, sf_dir)
    last = r.documents(spark, sf_dir).agg(F.max("doc_id")).first()[0]
    return dense.missing(chunks, chunks.filter(F.col("ordinal") == 0).select("chunk_id"), last)


def _offered(spark, sf_dir):
    """Stored vectors offered for chunks `<doc>-00000`; most ids are unknown."""
    first = r.documents(spark, sf_dir).select("number", "doc_id")
    return r.table(spark, sf_dir, "embeddings").join(
        first, F.col("vec_id") == F.col("number")
    ).select(
        F.format_string("%s-%05d", "doc_id", F.when(F.col("label") < 5, 0).otherwise(99999))
        .alias("chunk_id"), "embedding",
    )


_OFFERED = """offered AS (
  SELECT printf('%s-%05d', docs.doc_id, CASE WHEN label < 5 THEN 0 ELSE 99999 END) AS chunk_id,
         embedding FROM embeddings JOIN docs ON vec_id = number)"""


@check(q.select("""SELECT chunk_id, chunks.doc_id, CAST(embedding[1] AS DOUBLE) AS first_value
                   FROM offered JOIN chunks USING (chunk_id)""", _OFFERED))
def store_vectors(spark, sf_dir):
    return dense.store(r.chunks(spark, sf_dir), _offered(spark, sf_dir)).select(
        "chunk_id", "doc_id", F.col("embedding")[0].cast("double").alias("first_value")
    )


@check(q.select("""SELECT chunk_id FROM offered
                   WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)""", _OFFERED))
def unknown_vectors(spark, sf_dir):
    return dense.unknown_chunks(r.chunks(spark, sf_dir), _offered(spark, sf_dir)).select("chunk_id")


# -- listing ------------------------------------------------------------------

_MIMES = [*settings.EXPORT_TARGETS, settings.FOLDER_MIME, "application/zip", "NA"]
_LISTED = f"""listed AS (
  SELECT CASE WHEN doc_id % 13 = 12 THEN NULL ELSE 'f' || doc_id END AS id,
         CASE WHEN doc_id % 11 = 10 THEN NULL ELSE 'a/b:' || source || CASE doc_id % 4
           WHEN 0 THEN '.txt' WHEN 1 THEN '.zip' WHEN 2 THEN '' ELSE '.PDF' END END AS name,
         nullif([{", ".join(f"'{m}'" for m in _MIMES)}][CAST(doc_id % 6 AS INT) + 1], 'NA') AS mime,
         CASE WHEN doc_id % 17 = 16 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS modified,
         'f' || doc_id AS known_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE 'old' END
           AS known FROM documents),
files AS (
  SELECT *, coalesce(nullif(name, ''), id) AS shown, coalesce(modified, '') AS source_modified,
         CASE mime WHEN '{_MIMES[0]}' THEN 'docx' WHEN '{_MIMES[1]}' THEN 'xlsx'
           WHEN '{_MIMES[2]}' THEN 'pdf' END AS export_type
  FROM listed WHERE id IS NOT NULL AND coalesce(mime, '') <> '{settings.FOLDER_MIME}'),
named AS (
  SELECT *, id || '__' || regexp_replace(shown, '[<>:"/\\\\|?*]', '_', 'g') AS base FROM files),
staged_names AS (
  SELECT *, CASE WHEN export_type IS NOT NULL THEN base || '.' || export_type
    WHEN lower(regexp_extract(regexp_extract(shown, '([^/]*)$', 1), '[^.].*?(\\.[^.]+)$', 1))
      IN ({", ".join(f"'{e}'" for e in settings.EXTENSION_TYPES)}) THEN base END AS filename
  FROM named),
planned AS (
  SELECT id AS source_id, name, mime AS mime_type, source_modified, filename, export_type,
         '{settings.REMOTE_URI_PREFIX}' || id AS source_uri,
         substr(sha1(id || '|' || source_modified), 1, 16) AS doc_id,
         CASE WHEN filename IS NULL THEN 'unsupported' WHEN known = source_modified THEN 'unchanged'
              ELSE 'staged' END AS status FROM staged_names)"""


def _planned(spark, sf_dir):
    number = F.col("doc_id")
    endings = F.array(*[F.lit(x) for x in (".txt", ".zip", "", ".PDF")])
    rows = r.table(spark, sf_dir, "documents")
    listed = rows.select(
        F.when(number % 13 != 12, F.concat(F.lit("f"), number.cast("string"))).alias("id"),
        F.when(number % 11 != 10, F.concat(F.lit("a/b:"), "source", F.element_at(
            endings, (number % 4 + 1).cast("int")))).alias("name"),
        F.element_at(F.array(*[F.lit(m) for m in _MIMES]), (number % 6 + 1).cast("int"))
        .alias("mime"),
        F.when(number % 17 == 16, "NA").otherwise(F.col("n_chars").cast("string"))
        .alias("modified"),
    )
    versions = rows.select(
        F.concat(F.lit("f"), number.cast("string")).alias("source_id"),
        F.when(number % 2 == 0, F.col("n_chars").cast("string")).otherwise("old")
        .alias("source_modified"),
    )
    return listing.plan_listing(listing.clean_listing(listed), versions)


@check(f"WITH {_LISTED} SELECT * FROM planned")
def remote_listing(spark, sf_dir):
    return _planned(spark, sf_dir)


@check(f"""WITH {_LISTED} SELECT count(*) AS total, count_if(status = 'staged') AS staged,
  count_if(status = 'unchanged') AS unchanged, count_if(status = 'unsupported') AS unsupported
FROM planned""")
def remote_listing_totals(spark, sf_dir):
    return listing.listing_totals(_planned(spark, sf_dir))


# -- delimiter and prompts ----------------------------------------------------

_SNIFF_CTE = """texts AS (
  SELECT doc_id, replace(text, ',', CASE doc_id % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9)
           WHEN 3 THEN '|' ELSE '.' END) AS text FROM documents),
bare AS (SELECT doc_id, regexp_replace(text, '"[^"]*"', '', 'g') AS text FROM texts),
rows_of AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS no FROM bare)"""


_MARKS = [("','", "a"), ("';'", "b"), ("chr(9)", "c"), ("'|'", "d")]


@check(f"""WITH {_SNIFF_CTE},
counts AS (SELECT doc_id, no, {", ".join(
    f"length(line) - length(replace(line, {m}, '')) AS {n}" for m, n in _MARKS)}
  FROM rows_of WHERE {q.strip("line")} <> ''),
firsts AS (SELECT doc_id, {", ".join(f"arg_min({n}, no) AS {n}0" for _, n in _MARKS)}
  FROM counts GROUP BY 1),
shares AS (SELECT doc_id, {", ".join(
    f"CASE WHEN any_value({n}0) > 0 THEN count_if({n} = {n}0) ELSE 0 END AS {n}" for _, n in _MARKS)}
  FROM counts JOIN firsts USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN greatest(a, b, c, d) = 0 THEN ',' WHEN a = greatest(a, b, c, d) THEN ','
  WHEN b = greatest(a, b, c, d) THEN ';' WHEN c = greatest(a, b, c, d) THEN chr(9) ELSE '|' END
  AS delimiter FROM shares""")
def sniffed_delimiters(spark, sf_dir):
    marks = F.array(*[F.lit(x) for x in (",", ";", "\t", "|", ".")])
    return r.table(spark, sf_dir, "documents").select(
        "doc_id", dx.sniff_delimiter(F.replace("text", F.lit(","), F.element_at(
            marks, (F.col("doc_id") % 5 + 1).cast("int")))).alias("delimiter")
    )


@check("SELECT doc_id, text FROM documents")
def decoded_bytes(spark, sf_dir):
    """Text in and out of bytes; most documents also fit the Windows code page."""
    latin = F.encode("text", "ISO-8859-1")
    fits = F.decode(latin, "ISO-8859-1") == F.col("text")
    return r.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(fits & (F.col("doc_id") % 2 == 0), dx.decoded(latin))
        .otherwise(dx.decoded(F.encode("text", "UTF-8"))).alias("text"),
    )


_ROUTED = f"""measured AS (
  SELECT conv_id, turn, text, {q.words("text")} AS words, {q.approx_tokens("text")} AS tokens,
         CASE WHEN {q.words("text")} > 50 AND NOT contains(text, 'ü')
           THEN {q.strip("substr(text, 1, length(text) // 2)")} ELSE text END AS final
  FROM conversations)"""


def _shorter(model):
    """A caller's rewriter: the first half; fails on texts with `ü`."""

    def call(texts):
        if any("ü" in t for t in texts):
            raise ValueError("cannot rewrite this")
        return [t[: len(t) // 2] for t in texts]

    return call


@check(f"""WITH {_ROUTED}
SELECT conv_id, turn, text, final, CAST(words AS INT) AS original_words,
  CASE WHEN words <= 50 THEN 'passthrough' WHEN contains(text, 'ü')
    THEN 'passthrough (rewrite failed)' ELSE 'llm-rewrite' END AS method,
  CASE WHEN words <= 50 THEN words || ' words <= 50 threshold; sent unchanged'
    ELSE words || ' words > 50 threshold' END AS reason,
  CAST(tokens AS INT) AS original_tokens, CAST({q.words("final")} AS INT) AS final_words,
  CAST({q.approx_tokens("final")} AS INT) AS final_tokens,
  CASE WHEN tokens = 0 THEN 0.0 ELSE round((1 - {q.approx_tokens("final")} / tokens) * 100, 1) END
    AS reduction_pct
FROM measured""")
def prompt_routing(spark, sf_dir):
    return prompts.route_prompts(
        r.table(spark, sf_dir, "conversations").drop("role"), rewrite=_shorter
    )


@check("""SELECT page_id, reverse(url) AS text FROM pages""")
def transcribed_images(spark, sf_dir):
    """The transcription hook, with a model that reads an address backwards."""
    seen = model_calls.apply_model(
        r.table(spark, sf_dir, "pages").select("page_id", "url"), "url", "text", "string",
        _reader, settings.effort_profile("low").vision_model,
    )
    return seen.select("page_id", "text")


def _reader(model):
    return lambda paths: [p[::-1] for p in paths]


# -- stored tables and streams ------------------------------------------------


def _stored(spark, sf_dir):
    catalog = Catalog(spark, new_folder(spark, "catalog"), parts=4)
    chunks = r.chunks(spark, sf_dir)
    catalog.replace("chunks", chunks, chunks.select("doc_id").distinct())
    return catalog


@check(q.select("SELECT * FROM chunks"))
def stored_chunks(spark, sf_dir):
    """Chunks written to a catalog twice and read back."""
    catalog = _stored(spark, sf_dir)
    first = catalog.table("chunks").filter(F.col("ordinal") == 0)
    whole = r.chunks(spark, sf_dir)
    catalog.replace("chunks", whole, first.select("doc_id"))
    return catalog.table("chunks").select(*schemas.CHUNKS.names)


@check(q.select("SELECT chunk_id, doc_id, bucket, v FROM chunk_vecs JOIN chunks USING (chunk_id)",
                q.hash_vectors("chunks", "chunk_vecs", "chunk_id")))
def streamed_backfill(spark, sf_dir):
    """Vectors of a streaming backfill that is started twice."""
    catalog = _stored(spark, sf_dir)
    checkpoint = new_folder(spark, "stream")
    for _ in range(2):
        backfill_stream(catalog, checkpoint).awaitTermination()
    return catalog.table("chunk_embeddings").select(
        "chunk_id", "doc_id",
        F.posexplode(F.col("embedding").cast("array<double>")).alias("bucket", "v"),
    ).filter(F.col("v") != 0)
