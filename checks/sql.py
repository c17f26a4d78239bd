"""Common table expressions shared by the check SQL."""

from __future__ import annotations

from folioscan import settings
from folioscan.functions import terms
from folioscan.functions.text import WHITESPACE, WHITESPACE_CLASS

STOP = ", ".join(f"'{w}'" for w in ("", *settings.STOP_WORDS))
NL, BLANK = "chr(10)", "chr(10) || chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def newlines(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"


def words(x: str) -> str:
    """Word count."""
    return (
        f"CASE WHEN {strip(x)} = '' THEN 0 ELSE "
        f"len(regexp_split_to_array({strip(x)}, '[{WHITESPACE_CLASS}]+')) END"
    )


def approx_tokens(x: str) -> str:
    return f"greatest({words(x)}, length({x}) // 4)"


def chunk_id(doc: str = "doc_id", ordinal: str = "ordinal") -> str:
    return f"printf('%s-%05d', {doc}, CAST({ordinal} AS INT))"


EXT_TYPES = "(VALUES " + ", ".join(
    f"('{ext}', '{kind}')" for ext, kind in settings.EXTENSION_TYPES.items()
) + ") AS ext_types(ext, source_type)"

DOCS = f"""docs AS (
  SELECT substr(sha1(d.doc_id || '|' || d.n_chars), 1, 16) AS doc_id, d.doc_id AS number,
         d.source || '-' || d.doc_id || d.ext AS filename, d.ext, ext_types.source_type,
         CASE WHEN d.lang = 'en' THEN 'local' ELSE 'gdrive' END AS source,
         CAST(d.doc_id AS VARCHAR) AS source_id,
         'file:///' || d.source || '-' || d.doc_id || d.ext AS source_uri,
         CAST(d.n_chars AS VARCHAR) AS source_modified,
         CAST(NULL AS VARCHAR) AS summary,
         nullif({strip("split_part(d.text, chr(10), 1)")}, '') AS title,
         replace(d.text, {NL}, {BLANK}) AS text
  FROM (SELECT *, CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN '.txt'
          WHEN 1 THEN '.md' WHEN 2 THEN '.html' ELSE '.json' END AS ext FROM documents) d
  JOIN {EXT_TYPES} USING (ext))"""


def packed(source: str, name: str = "pieces", keys: str = "doc_id") -> str:
    """CTEs that pack `text` of `source` by paragraph: (keys, ordinal, text).

    `keys` is a comma-separated list that identifies a row of `source`.
    """
    on = " AND ".join(f"n.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    n_keys = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    return f"""{name}_split AS (
  SELECT {keys}, unnest(string_split({newlines("text")}, {BLANK})) AS p,
         generate_subscripts(string_split({newlines("text")}, {BLANK}), 1) AS pos
  FROM {source}),
{name}_paras AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i,
         {strip("p")} AS p, length({strip("p")}) AS size
  FROM {name}_split WHERE {strip("p")} <> ''),
{name}_fold AS (
  SELECT {keys}, i, 0 AS ordinal, size FROM {name}_paras WHERE i = 1
  UNION ALL
  SELECT {n_keys}, n.i,
         CASE WHEN k.size + n.size + 2 > 1200 THEN k.ordinal + 1 ELSE k.ordinal END,
         CASE WHEN k.size + n.size + 2 > 1200 THEN n.size ELSE k.size + n.size + 2 END
  FROM {name}_fold k JOIN {name}_paras n ON {on} AND n.i = k.i + 1),
{name} AS (
  SELECT {keys}, ordinal, string_agg(p, {BLANK} ORDER BY i) AS text
  FROM {name}_fold JOIN {name}_paras USING ({keys}, i) GROUP BY {keys}, ordinal)"""


CHUNKS = f"""{packed("docs")},
chunks AS (
  SELECT {chunk_id()} AS chunk_id, doc_id, CAST(ordinal AS INT) AS ordinal, text,
         'part ' || (ordinal + 1) AS locator, CAST(length(text) // 4 AS INT) AS token_estimate
  FROM pieces)"""

CATALOG = f"WITH RECURSIVE {DOCS},\n{CHUNKS}"

TAGS = """label_tags AS (
  SELECT docs.doc_id, unnest(['quality-' || quality, 'toxic-' || toxic]) AS tag
  FROM docs JOIN labels ON labels.doc_id = docs.number)"""

QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


def split_tokens(source: str, columns: str) -> str:
    return (
        f"SELECT * FROM (SELECT {columns}, unnest(regexp_split_to_array("
        f"strip_accents(lower(text)), '[^a-z]+')) AS term FROM {source}) WHERE term NOT IN ({STOP})"
    )


POSTINGS = f"""tokens AS ({split_tokens("chunks", "chunk_id, doc_id")}),
lengths AS (SELECT chunk_id, count(*) AS len FROM tokens GROUP BY 1),
postings AS (
  SELECT term, chunk_id, doc_id, CAST(count(*) AS INT) AS tf, CAST(any_value(len) AS INT) AS len
  FROM tokens JOIN lengths USING (chunk_id) GROUP BY 1, 2, 3),
frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
totals AS (
  SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM tokens) AS total_len)"""

SCORES = f"""wanted AS (SELECT DISTINCT * FROM ({split_tokens("queries", "query_id")})),
lexical_scores AS (
  SELECT query_id, chunk_id, doc_id, round(sum(
           ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2
           / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (total_len / n_chunks)))), 9) AS score
  FROM wanted JOIN frequencies USING (term) JOIN postings USING (term), totals
  GROUP BY 1, 2, 3)"""


def ranked(source: str, name: str, k: int) -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM {source})
  WHERE rank < {k})"""


def hash_vectors(source: str, name: str, key: str) -> str:
    """Sparse hashing vectors (key, bucket, v) in single precision."""
    return f"""{name}_counts AS (
  SELECT {key}, CAST('0x' || substr(sha1(t), 1, 8) AS BIGINT) % 64 AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {source})
  GROUP BY 1, 2),
{name} AS (
  SELECT {key}, bucket, CAST(CAST(n / sqrt(sum(CAST(n AS DOUBLE) * n) OVER (PARTITION BY {key}))
         AS FLOAT) AS DOUBLE) AS v
  FROM {name}_counts)"""


DENSE = f"""{hash_vectors("chunks", "chunk_vecs", "chunk_id")},
{hash_vectors("queries", "query_vecs", "query_id")},
chunk_norms AS (SELECT chunk_id, sqrt(sum(v * v)) AS size FROM chunk_vecs GROUP BY 1),
query_norms AS (SELECT query_id, sqrt(sum(v * v)) AS size FROM query_vecs GROUP BY 1),
dense_scores AS (
  SELECT q.query_id, n.chunk_id, c.doc_id,
         round(coalesce(dot, 0) / (n.size * q.size), 9) + 0.0 AS score
  FROM query_norms q CROSS JOIN chunk_norms n JOIN chunks c USING (chunk_id)
  LEFT JOIN (SELECT query_id, chunk_id, sum(a.v * b.v) AS dot
             FROM query_vecs a JOIN chunk_vecs b USING (bucket) GROUP BY 1, 2)
    USING (query_id, chunk_id))"""


def fused(limit: int) -> str:
    return f"""both_lists AS (
  SELECT query_id, chunk_id, doc_id, rank, 0 AS list_no FROM lexical
  UNION ALL SELECT query_id, chunk_id, doc_id, rank, 1 FROM dense),
sums AS (
  SELECT query_id, chunk_id, doc_id, sum(1.0 / (60 + rank)) AS score,
         min(list_no) AS first_list, arg_min(rank, list_no) AS first_rank
  FROM both_lists GROUP BY 1, 2, 3),
fused AS (
  SELECT * FROM (SELECT query_id, chunk_id, doc_id, score, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, first_list, first_rank, chunk_id) - 1 AS rank
  FROM sums) WHERE rank < {limit})"""


def select(body: str, *ctes: str) -> str:
    """A statement over the catalog CTEs and more."""
    return ",\n".join([CATALOG, *ctes]) + "\n" + body


# Porter's conditions on the part of a word before its suffix.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _is(pattern: str, x: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _m1(x: str) -> str:
    return _is(f"^({_C})?{_V}{_C}", x)


def _m1_exactly(x: str) -> str:
    return _is(f"^({_C})?{_V}{_C}({_V})?$", x)


def _m2(x: str) -> str:
    return _is(f"^({_C})?{_V}{_C}{_V}{_C}", x)


def _vowel(x: str) -> str:
    return _is(f"^({_C})?{_V}", x)


def _short(x: str) -> str:
    return _is(f"^{_C}[aeiouy][^aeiouwxy]$", x)


def _cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _suffixes(x: str, rules, condition) -> str:
    """The longest suffix that fits decides, whether its condition holds or not."""
    cases = " ".join(
        f"WHEN ends_with({x}, '{old}') THEN CASE WHEN {condition(_cut(x, len(old)), old)} "
        f"THEN {_cut(x, len(old))} || '{new}' ELSE {x} END"
        for old, new in sorted(rules, key=lambda rule: -len(rule[0]))
    )
    return f"CASE {cases} ELSE {x} END"


def _ion(base: str, suffix: str) -> str:
    return _m2(base) + (f" AND {_is('[st]$', base)}" if suffix == "ion" else "")


_ED = "regexp_replace(w, '(ed|ing)$', '')"
PORTER = f"""stem_0 AS (SELECT DISTINCT term, term AS w FROM tokens),
stem_1 AS (SELECT term, CASE WHEN {_is("(sses|ies)$", "w")} THEN {_cut("w", 2)}
  WHEN {_is("[^s]s$", "w")} THEN {_cut("w", 1)} ELSE w END AS w FROM stem_0),
stem_2 AS (SELECT term, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m1(_cut("w", 3))}
      THEN {_cut("w", 1)} ELSE w END
    WHEN {_ED} <> w AND {_vowel(_ED)} THEN CASE WHEN {_is("(at|bl|iz)$", _ED)} THEN {_ED} || 'e'
      WHEN {_is("[^aeiouylsz]$", _ED)} AND right({_ED}, 1) = left(right({_ED}, 2), 1)
        AND length({_ED}) > 1 THEN {_cut(_ED, 1)}
      WHEN {_m1_exactly(_ED)} AND {_short(_ED)} THEN {_ED} || 'e' ELSE {_ED} END
    ELSE w END AS w FROM stem_1),
stem_3 AS (SELECT term, CASE WHEN ends_with(w, 'y') AND {_vowel(_cut("w", 1))}
    THEN {_cut("w", 1)} || 'i' ELSE w END AS w FROM stem_2),
stem_4 AS (SELECT term, {_suffixes("w", terms.STEP_2, lambda b, _: _m1(b))} AS w FROM stem_3),
stem_5 AS (SELECT term, {_suffixes("w", terms.STEP_3, lambda b, _: _m1(b))} AS w FROM stem_4),
stem_6 AS (SELECT term, {_suffixes("w", [(x, "") for x in terms.STEP_4], _ion)} AS w FROM stem_5),
stem_7 AS (SELECT term, CASE WHEN ends_with(w, 'e') AND ({_m2(_cut("w", 1))}
    OR ({_m1_exactly(_cut("w", 1))} AND NOT {_short(_cut("w", 1))})) THEN {_cut("w", 1)}
    ELSE w END AS w FROM stem_6),
stems AS (SELECT term, CASE WHEN length(term) < 3 THEN term
    WHEN ends_with(w, 'll') AND {_m2(_cut("w", 1))} THEN {_cut("w", 1)} ELSE w END AS stem
  FROM stem_7)"""
