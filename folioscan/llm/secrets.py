"""Secret scan with corpus-wide ownership of what looks like a secret.

Spans of fixed kinds are found in every text. For each distinct value the scan counts, over
the whole corpus, the repositories and owners that hold it: values with many owners are
examples that were copied around, values of one owner look live. Opaque strings (long, of
mixed characters) are too many to report by look alone; ownership decides which are added.

Everything is a column expression or a join of narrow rows: texts never leave the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import stored, text_of


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, the group and length that decide, and further demands."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    demands: tuple[str, ...] = ()
    base: bool = True


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
KINDS = (
    Kind("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # Runs below the least length fail whole, so the length may stand in the pattern.
    Kind("access", r"AKIA[A-Z0-9]{14,}"),
    Kind("hex", r"[0-9a-f]{16,}"),
    Kind("opaque", r"[A-Za-z0-9_-]{20,}", 0, 20, ("[0-9]", "[a-z]", "[A-Z]"), base=False),
)
MAX_OWNERS = 1


def _hits(text: Column, order: int, kind: Kind) -> Column:
    """The kind's matches in a text: kind, number, code points before it, its length, value.

    Splitting at the pattern yields what lies between the matches, hence their places.
    """
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found
    gaps = F.split(text, kind.pattern, -1)
    made = F.transform(
        F.arrays_zip(found.alias("found"), values.alias("value"), gaps.alias("gap")),
        lambda x, i: F.struct(
            F.lit(order).alias("kind"), i.alias("number"),
            F.char_length(x["gap"]).alias("before"), F.char_length(x["found"]).alias("length"),
            x["value"].alias("value"),
        ),
    )
    hits = F.filter(made, lambda x: x["length"].isNotNull())
    return F.when(text.rlike(kind.pattern), hits).otherwise(F.array().cast(
        "array<struct<kind:int,number:int,before:int,length:int,value:string>>"))


def _key(text: Column, source: Column) -> Column:
    """Rows of equal text and source have equal spans; the digest joins spans to rows."""
    return F.unhex(F.sha2(F.concat(source, F.lit("\0"), text), 256))


def find_spans(
    docs: DataFrame, text_col: str = "text", source_col: str = "source",
    kinds: tuple[Kind, ...] = KINDS, max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """The spans of each distinct (text, source): secret_key, kind, start, end, base, owners.

    A row per span; texts without spans have none. The owner is the part of the source before
    "/", the repository is the whole; a null source is one unknown owner.
    """
    source, text = F.coalesce(F.col(source_col), F.lit("")), text_of(text_col)
    scanned = stored(docs.select(
        _key(text, source).alias("secret_key"), source.alias("repository"),
        F.concat(*(_hits(text, i, k) for i, k in enumerate(kinds))).alias("hits"),
    ).filter(F.size("hits") > 0), "secret-hits").dropDuplicates(["secret_key"])

    before = Window.partitionBy("secret_key", "kind").orderBy("number")
    placed = scanned.select("secret_key", "repository", F.inline("hits")).withColumn(
        "end", F.sum(F.col("before") + F.col("length")).over(before)
    )
    fits = F.lit(True)
    for i, kind in enumerate(kinds):
        value = F.col("value")
        good = F.char_length(value) >= kind.least
        for demand in kind.demands:
            good &= value.rlike(demand)
        fits &= (F.col("kind") != i) | good
    candidates = placed.filter(fits).select(
        "secret_key", "kind", (F.col("end") - F.col("length")).alias("start"), "end",
        F.sha2("value", 256).alias("secret"), "repository",
        F.substring_index("repository", "/", 1).alias("owner"),
    )
    # One row per value and repository before the counts: a hot value is combined early.
    owned = (
        candidates.groupBy("secret", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("secret", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("secret").agg(
            F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    base = F.col("kind").isin([i for i, k in enumerate(kinds) if k.base])
    return candidates.drop("repository", "owner").join(owned, "secret").filter(
        base | (F.col("owners") <= max_owners)
    ).select("secret_key", "kind", "start", "end", base.alias("base"), "owners", "repositories")


def _named(kinds: tuple[Kind, ...], span: Column) -> Column:
    name = F.element_at(F.array(*(F.lit(k.name) for k in kinds)), span["kind"] + 1)
    return F.concat_ws(":", name, span["start"].cast("string"), span["end"].cast("string"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    kinds: tuple[Kind, ...] = KINDS, max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """Per document: counts of the base kinds, digest of base spans, all spans, live values.

    Returns id, n_<kind> of each base kind, base_sha256, spans, n_live and n_copied (base
    spans whose value at most, or more than, `max_owners` owners hold). Spans are
    `kind:start:end` in code points, end exclusive, by start and then kind, comma-joined. A
    row per row of `docs`; repeated rows stay and a null text counts as empty.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(source_col).alias("src"))
    found = find_spans(rows, "body", "src", kinds, max_owners).groupBy("secret_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base", "owners")))
        .alias("spans"))
    key = _key(text_of("body"), F.coalesce("src", F.lit("")))
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["base"])

    def number(test) -> Column:
        return F.size(F.filter(base, test)).cast("bigint")

    def of_kind(order: int) -> Column:
        return number(lambda s: s["kind"] == order)

    counts = [of_kind(i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base]
    joined = F.array_join(F.transform(base, lambda s: _named(kinds, s)), ",")
    return rows.select("id", key.alias("secret_key")).join(found, "secret_key", "left").select(
        F.col("id").alias(id_col), *counts, F.sha2(joined, 256).alias("base_sha256"),
        F.array_join(F.transform(spans, lambda s: _named(kinds, s)), ",").alias("spans"),
        number(lambda s: s["owners"] <= max_owners).alias("n_live"),
        number(lambda s: s["owners"] > max_owners).alias("n_copied"),
    )


def mask(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", mark: str = "[secret]",
    kinds: tuple[Kind, ...] = KINDS, max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """`docs` with every span of `scan` in the text replaced by `mark`; all rows stay.

    Overlapping or touching spans become one mark. Other columns, also of names used here,
    are kept as they are; a null text stays null.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"),
        F.col(f"`{text_col}`").alias("body"), F.col(f"`{source_col}`").alias("src"))
    found = find_spans(rows, "body", "src", kinds, max_owners)
    # Spans that run into one another become one, by the furthest end so far.
    order = Window.partitionBy("secret_key").orderBy("start", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        found.select("secret_key", "start", "end", ahead.alias("ahead"))
        .withColumn("number", F.sum(
            (F.col("ahead").isNull() | (F.col("start") > F.col("ahead"))).cast("int")
        ).over(order))
        .groupBy("secret_key", "number")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("secret_key").agg(F.sort_array(F.collect_list(F.struct("start", "end")))
                                   .alias("spans"))
    )
    text, n = F.col("body"), F.size("spans")
    # What stands before each span, and after the last one.
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        text,
        F.when(i > 0, F.col("spans")[i - 1]["end"]).otherwise(0).cast("int") + 1,
        (F.when(i < n, F.col("spans")[i]["start"]).otherwise(F.char_length(text))
         - F.when(i > 0, F.col("spans")[i - 1]["end"]).otherwise(0)).cast("int"),
    ))
    masked = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(gaps, mark))
    key = _key(text_of("body"), F.coalesce("src", F.lit("")))
    return rows.withColumn("secret_key", key).join(merged, "secret_key", "left").select(*(
        masked.alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns))


def oracle(kinds: tuple[Kind, ...] = KINDS, max_owners: int = MAX_OWNERS) -> str:
    """The SQL of `scan` over `documents`, for a dialect with RE2 patterns."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    parts, names = [], " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(kinds))
    for i, k in enumerate(kinds):
        demands = "".join(f" AND regexp_matches(value, {quoted(d)})" for d in k.demands)
        parts.append(f"""
            SELECT * FROM (
              SELECT row_no, source, owner, {i} AS kind, value,
                sum(length(gap) + length(found)) OVER (PARTITION BY row_no ORDER BY n) AS stop,
                length(found) AS size
              FROM (
                SELECT row_no, source, owner, unnest(generate_series(1, len(hits))) AS n,
                  unnest(hits) AS found, unnest(vals) AS value,
                  unnest(gaps[1:len(hits)]) AS gap
                FROM (
                  SELECT row_no, source, owner,
                    regexp_extract_all(body, {quoted(k.pattern)}, 0) AS hits,
                    regexp_extract_all(body, {quoted(k.pattern)}, {k.group}) AS vals,
                    string_split_regex(body, {quoted(k.pattern)}) AS gaps
                  FROM docs)))
            WHERE length(value) >= {k.least}{demands}""")
    base = [i for i, k in enumerate(kinds) if k.base]
    listed = ", ".join(map(str, base))
    counts = ", ".join(
        f"CAST(count(*) FILTER (kind = {i}) AS BIGINT) AS n_{kinds[i].name}" for i in base)
    span = f"CASE kind {names} END || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    order = "ORDER BY start, kind"
    return f"""
        WITH docs AS (
          SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body,
            coalesce(source, '') AS source, split_part(coalesce(source, ''), '/', 1) AS owner
          FROM documents),
        placed AS ({" UNION ALL ".join(parts)}),
        owned AS (SELECT value, count(DISTINCT owner) AS owners FROM placed GROUP BY value),
        judged AS (
          SELECT placed.*, stop - size AS start, owners FROM placed JOIN owned USING (value)
          WHERE kind IN ({listed}) OR owners <= {max_owners}),
        per_row AS (
          SELECT row_no, {counts},
            string_agg({span}, ',' {order}) FILTER (kind IN ({listed})) AS base,
            string_agg({span}, ',' {order}) AS spans,
            count(*) FILTER (kind IN ({listed}) AND owners <= {max_owners}) AS n_live,
            count(*) FILTER (kind IN ({listed}) AND owners > {max_owners}) AS n_copied
          FROM judged GROUP BY row_no)
        SELECT doc_id, {", ".join(f"coalesce(n_{kinds[i].name}, 0) AS n_{kinds[i].name}"
                                  for i in base)},
          sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
          coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM docs LEFT JOIN per_row USING (row_no)"""
