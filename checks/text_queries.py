"""Keys, text functions, chunking and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import relations as r
from checks import sql as q
from checks.registry import check
from folioscan import settings
from folioscan.functions import html as hx
from folioscan.functions import json_lines as jx
from folioscan.functions import keys
from folioscan.functions import text as tx
from folioscan.functions.text import WHITESPACE_CLASS
from folioscan.operators import chunking
from folioscan.operators.running import running_before
from folioscan.sources import splits
from folioscan.sources.shared import kept_once, new_folder

# Lines in one of the files that the split readers are given.
FILE_ROWS = 1 << 21


@check("""SELECT doc_id AS number, substr(sha1(doc_id || '|' || n_chars), 1, 16) AS key
          FROM documents""")
def document_ids(spark, sf_dir):
    return r.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("number"),
        keys.document_id(F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
        .alias("key"),
    )


@check(f"""SELECT number, ext, source_type FROM (
             SELECT doc_id AS number, lower(regexp_extract(name, '[^.].*?(\\.[^.]+)$', 1)) AS ext
             FROM (SELECT doc_id, source || '.v' || doc_id || CASE doc_id % 7
                     WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' WHEN 3 THEN '.Jpeg'
                     WHEN 4 THEN '.xlsm' WHEN 5 THEN '.jsonl' ELSE '.md' END AS name
                   FROM documents))
           LEFT JOIN {q.EXT_TYPES} USING (ext)""")
def extension_types(spark, sf_dir):
    endings = F.array(*[F.lit(x) for x in
                        (".PDF", ".tar.gz", "", ".Jpeg", ".xlsm", ".jsonl", ".md")])
    name = F.concat("source", F.lit(".v"), F.col("doc_id").cast("string"),
                    F.element_at(endings, (F.col("doc_id") % 7 + 1).cast("int")))
    return r.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("number"), tx.extension(name).alias("ext"),
        tx.source_type(tx.extension(name)).alias("source_type"),
    )


@check(q.select("SELECT * FROM chunks"))
def text_chunks(spark, sf_dir):
    return r.chunks(spark, sf_dir)


def _markdown(spark, sf_dir):
    """Documents as markdown: short lines become headings of level 1 to 6."""
    line = F.col("line")
    return r.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.array_join(F.transform(
            F.split("text", "\n"),
            lambda x: F.when((F.length(x) < 60) & (x != ""), F.concat(
                F.substring(F.lit("######"), 1, (F.length(x) % 6 + 1).cast("int")), F.lit(" "), x,
                F.lit("  "))).otherwise(F.concat(x, F.lit("\n")))), "\n").alias("text"),
    )


_HEADING = f"^#{{1,6}}[{WHITESPACE_CLASS}]+(.*[^{WHITESPACE_CLASS}])[{WHITESPACE_CLASS}]*$"
_MARKDOWN_CTE = f"""lined AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS x,
         generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
marked AS (
  SELECT doc_id, string_agg(CASE WHEN length(x) < 60 AND x <> ''
      THEN repeat('#', length(x) % 6 + 1) || ' ' || x || '  ' ELSE x || chr(10) END,
      chr(10) ORDER BY no) AS text FROM lined GROUP BY 1),
md_lines AS (
  SELECT doc_id, unnest(regexp_split_to_array(text,
           '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]')) AS line,
         generate_subscripts(regexp_split_to_array(text,
           '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), 1) AS no FROM marked),
md_heads AS (
  SELECT *, CASE WHEN regexp_matches(line, '{_HEADING}')
    THEN {q.strip(f"regexp_extract(line, '{_HEADING}', 1)")} END AS heading FROM md_lines),
md_section_no AS (
  SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM md_heads),
md_sections AS (
  SELECT doc_id, section, coalesce(max(heading), 'preamble') AS heading,
         {q.strip("coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (heading IS NULL), '')")} AS body
  FROM md_section_no GROUP BY 1, 2),
md_kept AS (SELECT * FROM md_sections WHERE body <> '' OR heading <> 'preamble')"""


@check(f"""WITH {_MARKDOWN_CTE}
SELECT doc_id, section_no, heading, body FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS section_no
  FROM md_kept)""")
def markdown_sections(spark, sf_dir):
    return _markdown(spark, sf_dir).select(
        "doc_id", F.posexplode(tx.markdown_sections(F.col("text"))).alias("section_no", "s")
    ).select("doc_id", "section_no", "s.heading", "s.body")


_MD_PIECES = q.packed("md_text", "md_pieces", "doc_id, section")


@check(f"""WITH RECURSIVE {_MARKDOWN_CTE},
md_text AS (SELECT doc_id, section, heading, CASE WHEN heading = 'preamble' THEN body
  ELSE {q.strip("heading || chr(10) || chr(10) || body")} END AS text FROM md_kept),
{_MD_PIECES}
SELECT {q.chunk_id()} AS chunk_id, doc_id, ordinal, text, heading AS locator,
       CAST(length(text) // 4 AS INT) AS token_estimate
FROM (SELECT p.doc_id, p.text, m.heading, CAST(row_number() OVER (
        PARTITION BY p.doc_id ORDER BY p.section, p.ordinal) - 1 AS INT) AS ordinal
      FROM md_pieces p JOIN md_text m USING (doc_id, section))""")
def markdown_chunks(spark, sf_dir):
    return chunking.markdown_chunks(_markdown(spark, sf_dir))


@check(f"""WITH {_MARKDOWN_CTE}
SELECT doc_id, title FROM (SELECT DISTINCT doc_id FROM marked) LEFT JOIN (
  SELECT doc_id, arg_min(heading, section) AS title FROM md_kept WHERE heading <> 'preamble'
  GROUP BY 1) USING (doc_id)""")
def markdown_titles(spark, sf_dir):
    return chunking.markdown_titles(_markdown(spark, sf_dir))


# Written from the rules of markup, not from the engine's pattern: comments and elements
# without text go first, then declarations and tags, whose quoted values may hold `>`.
_NOT_TEXT = (
    "(?is)<!--.*?-->|<(?:script|style|noscript)(?:\\s[^>]*)?>.*?</(?:script|style|noscript)\\s*>"
    "|<!doctype[^>]*>|</?[a-z][a-z0-9-]*(?:[^\"''>]|\"[^\"]*\"|''[^'']*'')*>"
)
_PAGES_CTE = f"""page_text AS (
  SELECT CAST(page_id AS VARCHAR) AS doc_id,
         regexp_replace(regexp_replace({q.newlines("html")}, '{_NOT_TEXT}', chr(1), 'g'),
                        chr(1) || '+', chr(10), 'g') AS marked FROM pages),
page_bodies AS (
  SELECT doc_id, {q.strip(
      "regexp_replace(replace(replace(replace(replace(replace(replace(replace(marked, "
      "'&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&lt;', '<'), "
      "'&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&'), '\\n{3,}', chr(10) || chr(10), 'g')"
  )} AS text FROM page_text)"""


@check(f"WITH {_PAGES_CTE} SELECT doc_id, text FROM page_bodies")
def html_text(spark, sf_dir):
    return r.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("doc_id"), hx.body_text(F.col("html")).alias("text")
    )


# Numbers 128 to 159 of the Windows code page; the five without a character stand for themselves.
_WINDOWS = ", ".join(
    f"'{bytes([n]).decode('cp1252')}'" if n not in (129, 141, 143, 144, 157) else f"chr({n})"
    for n in range(128, 160))


@check(f"""SELECT page_id, 'x?a=' || page_id || '&beta=2 β ©right; ¬it; ¬ é& &nosuch; <'
  || CASE WHEN n = 0 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN [{_WINDOWS}][n - 127]
     WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 THEN '' ELSE chr(n) END || '|' AS text
  FROM (SELECT page_id, CAST(page_id % 5000 AS INT) AS n FROM pages)""")
def html_references(spark, sf_dir):
    """Named references with and without a semicolon, and a number per page."""
    code = (F.col("page_id") % 5000).cast("string")
    return r.table(spark, sf_dir, "pages").select("page_id", hx.decode_entities(F.concat(
        F.lit("x?a="), F.col("page_id").cast("string"),
        F.lit("&beta=2 &beta; &copyright; &notit; &not &eacute& &nosuch; &lt&#"), code,
        F.lit(";|"))).alias("text"))


@check(f"""SELECT CAST(page_id AS VARCHAR) AS doc_id, nullif({q.strip(
    "replace(replace(replace(replace(regexp_extract(html, "
    "'(?is)<title[^>]*>(.*?)</title>', 1), '&copy;', chr(169)), '&middot;', chr(183)), "
    "'&quot;', chr(34)), '&amp;', '&')")}, '') AS title FROM pages""")
def html_titles(spark, sf_dir):
    return r.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("doc_id"), hx.title(F.col("html")).alias("title")
    )


@check(f"""WITH RECURSIVE {_PAGES_CTE}, {q.packed("page_bodies")}
SELECT {q.chunk_id()} AS chunk_id, doc_id, CAST(ordinal AS INT) AS ordinal, text,
       'part ' || (ordinal + 1) AS locator, CAST(length(text) // 4 AS INT) AS token_estimate
FROM pieces""")
def html_chunks(spark, sf_dir):
    return chunking.html_chunks(r.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("doc_id"), "html"
    ))


@check("""SELECT doc_id, ordinal, printf('%s-%05d', doc_id, ordinal) AS chunk_id,
  string_agg(line, chr(10) ORDER BY o_orderkey) AS body,
  'o_orderkey,o_orderstatus,o_orderpriority' || chr(10)
    || string_agg(line, chr(10) ORDER BY o_orderkey) AS text,
  'rows ' || (min(row_no) + 1) || '-' || (max(row_no) + 1) AS locator
FROM (SELECT o_orderstatus AS doc_id, o_orderkey, row_no, CAST(row_no // 50 AS INT) AS ordinal,
        o_orderkey || ',' || o_orderstatus || ',' || coalesce(nullif(o_orderpriority, '5-LOW'), '')
        AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1
              AS row_no FROM orders))
GROUP BY doc_id, ordinal""".replace(
    "  string_agg(line, chr(10) ORDER BY o_orderkey) AS body,\n", "", 1))
def delimited_chunks(spark, sf_dir):
    rows = _order_rows(spark, sf_dir)
    return chunking.delimited_chunks(
        rows, F.lit("o_orderkey,o_orderstatus,o_orderpriority")
    ).drop("token_estimate")


def _item_files(spark, sf_dir, line):
    """Large files of the line items of each return flag, in their order.

    A file has FILE_ROWS lines at most and `first_row` in its path. Rows are ordered and
    numbered by ranges, so no task holds all lines of a flag.
    """
    flag, order = "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ordered = r.table(spark, sf_dir, "lineitem").select(
        flag, *order, "l_linestatus").repartitionByRange(flag, *order).sortWithinPartitions(
        flag, *order)
    # The ids of a range follow its order, so its rows are numbered without a window.
    items = kept_once(ordered.withColumn("range", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id())).withColumn("note", F.concat(
            "l_linestatus", F.lit('\n"'), F.col("l_partkey").cast("string"), F.lit('", '),
            F.col("l_suppkey").cast("string")))
    whole = Window.partitionBy(flag)
    ahead = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = items.groupBy(flag, "range").agg(
        F.count("*").alias("held"), F.min("at").alias("lowest")).select(
        F.col(flag).alias("_flag"), F.col("range").alias("_range"), "lowest",
        F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"),
        F.sum("held").over(whole).alias("total"))
    same = F.col(flag).eqNullSafe(F.col("_flag")) & (F.col("range") == F.col("_range"))
    numbered = items.join(F.broadcast(ranges), same).withColumn(
        "row_no", F.col("before") + F.col("at") - F.col("lowest")).withColumn(
        "first_row", F.col("row_no") - F.col("row_no") % FILE_ROWS).withColumn(
        "last", (F.col("row_no") == F.col("total") - 1)
        | (F.col("row_no") % FILE_ROWS == FILE_ROWS - 1))
    path = new_folder(spark, "items")
    numbered.select(line.alias("value"), flag, "first_row", "row_no").repartition(
        flag, "first_row").sortWithinPartitions(flag, "first_row", "row_no").select(
        "value", flag, "first_row").write.partitionBy(flag, "first_row").text(path)
    return path


def _flag(path):
    return F.regexp_extract(path, "l_returnflag=([^/]*)", 1)


def _row_no(path, number):
    """Number of a record among all of its flag."""
    return F.regexp_extract(path, "first_row=([0-9]*)", 1).cast("bigint") + number


_ITEMS = """SELECT l_returnflag AS flag, CAST(row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS row_no,
  CAST(l_orderkey AS BIGINT) AS item,
  l_linestatus || chr(10) || '"' || l_partkey || '", ' || l_suppkey AS note
FROM lineitem"""


@check(_ITEMS)
def split_delimited(spark, sf_dir):
    """Records with quoted line breaks of files that several tasks read."""
    quoted = F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))
    path = _item_files(spark, sf_dir, F.concat_ws(",", "l_orderkey", quoted))
    return splits.delimited_records(spark, path).select(
        _flag("local_path").alias("flag"), _row_no("local_path", F.col("row_no")).alias("row_no"),
        F.col("cells")[0].cast("bigint").alias("item"), F.col("cells")[1].alias("note"))


@check(_ITEMS)
def split_json(spark, sf_dir):
    """Elements of JSON arrays that several tasks read."""
    value = F.to_json(F.struct(F.col("l_orderkey").alias("item"), "note"))
    path = _item_files(spark, sf_dir, F.concat(
        F.when(F.col("row_no") == F.col("first_row"), "[").otherwise(","), value,
        F.when(F.col("last"), "]").otherwise("")))
    found = splits.json_array_records(spark, path)
    parsed = F.from_json("json", "item bigint, note string")
    return found.select(
        _flag("local_path").alias("flag"),
        _row_no("local_path", F.col("record_no")).alias("row_no"),
        parsed["item"].alias("item"), parsed["note"].alias("note"))


def _order_rows(spark, sf_dir):
    """Orders as delimited files, one per status: few files with very many rows."""
    rows = r.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("doc_id"), "o_orderkey",
        F.array(
            F.col("o_orderkey").cast("string"), "o_orderstatus",
            F.nullif("o_orderpriority", F.lit("5-LOW")),
        ).alias("cells"),
    )
    return running_before(rows, ["doc_id"], "o_orderkey", name="row_no")


@check("""SELECT o_orderstatus AS doc_id, CAST(count(*) AS BIGINT) AS page_count
          FROM orders GROUP BY 1""")
def delimited_row_counts(spark, sf_dir):
    return r.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("doc_id")).agg(
        F.count("*").alias("page_count")
    )


@check("""SELECT event_id, CAST(e.value AS VARCHAR) AS k, 'k: ' || e.value AS flat
          FROM (SELECT event_id, json_extract_string(props, '$.k') AS value FROM events) e""")
def flat_json(spark, sf_dir):
    return r.table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        jx.flatten_json("props").alias("flat"),
    )


@check("""SELECT event_id, 'a.b[0]: ' || event_id || chr(10) || 'a.b[1]: ' || chr(10)
  || 'a.b[2].c: True' || chr(10) || 'p.k: ' || json_extract_string(props, '$.k') || chr(10)
  || 'f: ' AS flat FROM events""")
def nested_json(spark, sf_dir):
    """Objects, arrays, null, a boolean, an empty array and an empty text, nested."""
    value = F.concat(
        F.lit('{"a": {"b": ['), F.col("event_id").cast("string"),
        F.lit(', null, {"c": true}]}, "p": '), F.col("props"), F.lit(', "e": [], "f": ""}'))
    return r.table(spark, sf_dir, "events").select(
        "event_id", jx.flatten_json(value).alias("flat"))


@check("""SELECT event_type AS doc_id, event_id AS record_no,
  CASE WHEN event_id % 11 = 0 THEN 'no record' ELSE 'not JSON' END AS error
FROM events WHERE event_id % 11 = 0 OR event_id % 7 = 0""")
def record_rejects(spark, sf_dir):
    """Records that are null or do not parse, of a table where some are."""
    number = F.col("event_id")
    json = F.when(number % 11 == 0, F.lit(None)).when(
        number % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    records = r.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("doc_id"), number.alias("record_no"), json.alias("json"))
    return chunking.record_rejects(records)


_RECORDS_CTE = """recs AS (
  SELECT event_type AS doc_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1
           AS record_no,
         'event: ' || event_id || chr(10) || 'type: ' || event_type || chr(10)
         || 'props.k: ' || json_extract_string(props, '$.k') || chr(10)
         || 'note: ' || repeat('x', CAST(event_id % 97 AS INT) * 14) AS block
  FROM events),
fold AS (
  SELECT doc_id, record_no, 0 AS group_no,
         CASE WHEN length(block) > 1200 THEN 0 ELSE length(block) + 2 END AS size
  FROM recs WHERE record_no = 0
  UNION ALL
  SELECT n.doc_id, n.record_no,
         CASE WHEN k.size = 0 OR k.size + length(n.block) > 1200 THEN k.group_no + 1
              ELSE k.group_no END,
         CASE WHEN length(n.block) > 1200 THEN 0
              WHEN k.size = 0 OR k.size + length(n.block) > 1200 THEN length(n.block) + 2
              ELSE k.size + length(n.block) + 2 END
  FROM fold k JOIN recs n ON n.doc_id = k.doc_id AND n.record_no = k.record_no + 1)"""


def _event_records(spark, sf_dir):
    """Events as JSON Lines files, one per event type: few files, very many records."""
    records = r.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("doc_id"), "event_id",
        F.concat(
            F.lit('{"event": '), F.col("event_id").cast("string"), F.lit(', "type": "'),
            "event_type", F.lit('", "props": '), "props", F.lit(', "none": {}, "note": "'),
            F.repeat(F.lit("x"), ((F.col("event_id") % 97) * 14).cast("int")), F.lit('"}'),
        ).alias("json"),
    )
    return running_before(records, ["doc_id"], "event_id", name="record_no")


@check(f"""WITH RECURSIVE {_RECORDS_CTE},
record_groups AS (
  SELECT doc_id, group_no, min(record_no) AS a, max(record_no) AS b,
         string_agg(block, chr(10) || chr(10) ORDER BY record_no) AS text
  FROM fold JOIN recs USING (doc_id, record_no) GROUP BY 1, 2)
SELECT {q.chunk_id("doc_id", "group_no")} AS chunk_id, doc_id,
       CAST(group_no AS INT) AS ordinal, text,
       CASE WHEN a = b THEN 'record ' || (a + 1) ELSE 'records ' || (a + 1) || '-' || (b + 1) END
         AS locator, CAST(length(text) // 4 AS INT) AS token_estimate
FROM record_groups""")
def record_chunks(spark, sf_dir):
    return chunking.record_chunks(_event_records(spark, sf_dir))


@check("""SELECT doc_id, CAST(i AS INT) AS record_no, flat FROM (
  SELECT CAST(event_id AS VARCHAR) AS doc_id, unnest(range(n)) AS i,
         'k: ' || json_extract_string(props, '$.k') AS flat
  FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS n
        FROM events))""")
def json_file_records(spark, sf_dir):
    """Arrays, single objects, JSON Lines under both extensions, and blank files."""
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]")))
        .when(kind == 1, F.col("props"))
        .when(kind == 2, F.concat("props", F.lit("\n\n"), "props", F.lit("\n"), "props"))
        .otherwise(F.lit(" \n"))
    )
    ext = F.when(F.col("event_id") % 8 == 2, ".json").otherwise(
        F.when(kind == 2, ".jsonl").otherwise(".json")
    )
    return r.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("doc_id"), jx.json_records(text, ext).alias("j")
    ).select("doc_id", F.posexplode("j.records").alias("record_no", "flat"))


@check("""SELECT printf('%s-%05d', doc_id, 0) AS chunk_id, doc_id, CAST(0 AS INT) AS ordinal,
  flat || chr(10) || chr(10) || flat AS text, 'records 1-2' AS locator,
  CAST(length(flat || chr(10) || chr(10) || flat) // 4 AS INT) AS token_estimate
FROM (SELECT CAST(event_id AS VARCHAR) AS doc_id,
             'k: ' || json_extract_string(props, '$.k') AS flat FROM events)""")
def json_file_chunks(spark, sf_dir):
    text = F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]"))
    return chunking.json_file_chunks(
        r.table(spark, sf_dir, "events").select(
            F.col("event_id").cast("string").alias("doc_id"),
            jx.json_records(text, F.lit(".json"))["records"].alias("records"),
        )
    )


def _pages_of_text(spark, sf_dir):
    """One document per source, one page per row; some pages blank, some transcribed."""
    return r.table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), (F.col("doc_id") + 1).alias("page_no"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(" \n")).otherwise(
            F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"),
        (F.col("n_chars") % 7 == 0).alias("is_ocr"),
    )


@check(f"""WITH RECURSIVE src AS (
  SELECT source AS doc_id, doc_id + 1 AS page_no, n_chars % 7 = 0 AS is_ocr,
         {q.strip("CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE replace(text, chr(10), chr(10) || chr(10)) END")}
         AS text FROM documents),
{q.packed("src", "pieces", "doc_id, page_no")},
numbered AS (
  SELECT p.doc_id, p.page_no, p.text, is_ocr, CAST(row_number() OVER (
    PARTITION BY p.doc_id ORDER BY p.page_no, p.ordinal) - 1 AS INT) AS ordinal
  FROM pieces p JOIN src USING (doc_id, page_no))
SELECT {q.chunk_id()} AS chunk_id, doc_id, ordinal, text,
       'page ' || page_no || CASE WHEN is_ocr THEN ' (ocr)' ELSE '' END AS locator,
       CAST(length(text) // 4 AS INT) AS token_estimate FROM numbered""")
def page_chunks(spark, sf_dir):
    return chunking.page_chunks(_pages_of_text(spark, sf_dir))


@check("""SELECT source AS doc_id, CAST(count(*) AS INT) AS page_count,
                 count_if(n_chars % 7 = 0) AS ocr_pages FROM documents GROUP BY 1""")
def page_totals(spark, sf_dir):
    return chunking.page_totals(_pages_of_text(spark, sf_dir))


def _sheet_rows(spark, sf_dir):
    """Customers as workbooks by segment, sheets by nation; blank rows in between."""
    blank = F.col("c_custkey") % 9 == 0
    return r.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("doc_id"), F.col("c_nationkey").alias("sheet_no"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("sheet"),
        F.col("c_custkey").alias("row_no"),
        F.array(
            F.when(~blank, F.col("c_name")),
            F.when(~blank & (F.col("c_custkey") % 4 != 0), F.col("c_mktsegment"))
            .otherwise(F.when(blank, F.lit(""))),
        ).alias("cells"),
    )


_SHEETS_SQL = f"""WITH cells AS (
  SELECT c_mktsegment AS doc_id, c_nationkey AS sheet_no, 'N' || c_nationkey AS sheet,
         c_custkey AS row_no, c_name || ',' || CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment
           ELSE '' END AS line
  FROM customer WHERE c_custkey % 9 <> 0),
numbered AS (
  SELECT *, row_number() OVER w - 1 AS i, first_value(line) OVER w AS header,
         count(*) OVER (PARTITION BY doc_id, sheet_no) AS n
  FROM cells WINDOW w AS (PARTITION BY doc_id, sheet_no ORDER BY row_no)),
blocks AS (
  SELECT doc_id, sheet_no, greatest(i - 1, 0) // 50 AS block, any_value(sheet) AS sheet,
         CASE WHEN any_value(n) = 1 THEN '' ELSE any_value(header) || chr(10) END
         || string_agg(line, chr(10) ORDER BY i) AS text
  FROM numbered WHERE i > 0 OR n = 1 GROUP BY 1, 2, 3),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sheet_no, block) - 1 AS INT)
    AS ordinal FROM blocks)
SELECT {q.chunk_id()} AS chunk_id, doc_id, ordinal, text, 'sheet ''' || sheet || '''' AS locator,
       CAST(length(text) // 4 AS INT) AS token_estimate FROM placed"""


@check(_SHEETS_SQL)
def sheet_chunks(spark, sf_dir):
    return chunking.sheet_chunks(_sheet_rows(spark, sf_dir))


def _blocks(spark, sf_dir):
    """Conversations as document bodies: user turns are paragraphs, the rest tables."""
    cells = F.transform(F.split("text", "\n"), lambda line: F.split(line, ", "))
    return r.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("block_no"),
        F.when(F.col("role") == "user", "para").otherwise("table").alias("kind"),
        "text", cells.alias("cells"),
    )


_BLOCKS_CTE = f"""cell_rows AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM conversations WHERE role <> 'user'),
tables AS (
  SELECT conv_id, turn, string_agg(shown, chr(10) ORDER BY no) AS text FROM (
    SELECT *, array_to_string(list_transform(string_split(line, ', '),
      lambda c: replace({q.strip("c")}, chr(10), ' ')), ',') AS shown FROM cell_rows)
  WHERE replace(shown, ',', '') <> '' OR len(list_filter(string_split(line, ', '),
      lambda c: {q.strip("c")} <> '')) > 0
  GROUP BY 1, 2),
body AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, {q.strip("text")} AS text, true AS para
  FROM conversations WHERE role = 'user'
  UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, text, false FROM tables)"""


@check(f"""WITH RECURSIVE {_BLOCKS_CTE},
whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
          FROM body WHERE text <> '' GROUP BY 1),
{q.packed("whole")}
SELECT {q.chunk_id()} AS chunk_id, doc_id, CAST(ordinal AS INT) AS ordinal, text,
       'block ' || (ordinal + 1) AS locator, CAST(length(text) // 4 AS INT) AS token_estimate
FROM pieces""")
def block_chunks(spark, sf_dir):
    return chunking.block_chunks(_blocks(spark, sf_dir))


@check(f"""WITH {_BLOCKS_CTE}
SELECT doc_id, arg_min(text, turn) AS title FROM body WHERE para AND text <> '' GROUP BY 1""")
def block_titles(spark, sf_dir):
    return chunking.block_titles(_blocks(spark, sf_dir))


@check(q.select("""SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text
                   FROM chunks GROUP BY 1"""))
def document_texts(spark, sf_dir):
    return chunking.document_text(r.chunks(spark, sf_dir))


@check(f"""SELECT conv_id, turn, CAST({q.words("text")} AS INT) AS words,
  CAST({q.approx_tokens("text")} AS INT) AS tokens, CAST(length(text) // 4 AS INT) AS estimate,
  substr(regexp_replace({q.strip("text")}, '[{WHITESPACE_CLASS}]+', ' ', 'g'), 1, 240) AS snippet,
  substr(text, 1, 6000) AS sample
FROM conversations""")
def text_measures(spark, sf_dir):
    t = F.col("text")
    return r.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.word_count(t).cast("int").alias("words"),
        tx.approx_tokens(t).cast("int").alias("tokens"), tx.token_estimate(t).alias("estimate"),
        tx.snippet(t).alias("snippet"), tx.sample(t).alias("sample"),
    )


@check(f"""SELECT conv_id, turn, CASE WHEN cleaned = '' THEN 'untitled' ELSE cleaned END AS name
FROM (SELECT conv_id, turn, {q.strip('''regexp_replace(CASE WHEN turn % 5 = 4 THEN ' '
  ELSE replace(replace(text, ',', ':'), 'e', '/') END, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g')''')}
  AS cleaned FROM conversations)""")
def safe_file_names(spark, sf_dir):
    raw = F.when(F.col("turn") % 5 == 4, F.lit(" ")).otherwise(
        F.replace(F.replace("text", F.lit(","), F.lit(":")), F.lit("e"), F.lit("/"))
    )
    return r.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.safe_file_name(raw).alias("name")
    )


@check("""SELECT doc_id AS number, CASE WHEN marker IN ('NA', 'NA_character_', '<NA>') THEN NULL
  ELSE marker END AS value FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'NA'
    WHEN 1 THEN 'NA_character_' WHEN 2 THEN '<NA>' WHEN 3 THEN source END AS marker
  FROM documents)""")
def missing_values(spark, sf_dir):
    markers = F.array(*[F.lit(m) for m in settings.MISSING_MARKERS], "source", F.lit(None))
    return r.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("number"),
        tx.missing_to_null(F.element_at(markers, (F.col("doc_id") % 5 + 1).cast("int")))
        .alias("value"),
    )
