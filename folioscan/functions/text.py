"""Whitespace, counting and packing of plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan import settings

# ---- fixed values: the characters a Unicode-aware strip() removes ------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
WHITESPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
ILLEGAL_IN_FILE_NAME = r'[<>:"/\\|?*\x00-\x1f]'
# ------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times inside `body`.

    An expression repeated inside a lambda is evaluated on every call of the
    lambda; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def universal_newlines(text: Column) -> Column:
    """Turn CRLF and CR into LF, as reading a file in text mode does."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines(text: Column) -> Column:
    """The lines of `text`, broken at every Unicode line boundary."""
    return F.split(text, LINE_BREAK)


def collapse_whitespace(text: Column) -> Column:
    """Strip, and turn every inner run of whitespace into one space."""
    return F.regexp_replace(strip(text), f"[{WHITESPACE_CLASS}]+", " ")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(
        F.regexp_count(bare, F.lit(f"[{WHITESPACE_CLASS}]+")) + 1
    )


def token_estimate(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def approx_tokens(text: Column) -> Column:
    """The larger of the word count and the token estimate."""
    return F.greatest(word_count(text), token_estimate(text))


def snippet(text: Column, chars: int = settings.SNIPPET_CHARS) -> Column:
    """One-line preview of `text`."""
    return F.substring(collapse_whitespace(text), 1, chars)


def sample(text: Column, chars: int = settings.SAMPLE_CHARS) -> Column:
    """The part of a document that is shown to a model."""
    return F.substring(text, 1, chars)


def safe_file_name(name: Column) -> Column:
    """Replace characters no file system takes; a blank name becomes `untitled`."""
    cleaned = strip(F.regexp_replace(F.coalesce(name, F.lit("")), ILLEGAL_IN_FILE_NAME, "_"))
    return F.when(cleaned == "", F.lit("untitled")).otherwise(cleaned)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty when the name has none."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.].*?(\.[^.]+)$", 1))


def source_type(ext: Column) -> Column:
    """Document type of a lower-case extension; null when unsupported."""
    table = F.create_map(*[F.lit(x) for pair in settings.EXTENSION_TYPES.items() for x in pair])
    return F.try_element_at(table, ext)


def missing_to_null(value: Column) -> Column:
    """Map the textual markers of a missing value to null."""
    return F.when(~value.isin(*settings.MISSING_MARKERS), value)


def group_starts(lengths: Column, max_chars: int, entry: Column | None = None) -> Column:
    """Indexes of the items that open a new group, packing greedily in order.

    The state is the number of characters the next item would be appended after
    (text so far and a separator); zero means that no group is open. An item longer
    than `max_chars` is a group of its own. `entry` is the state left behind by
    the items before this array.
    """
    begin = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0).alias("i"),
        (F.lit(0) if entry is None else entry.cast("int")).alias("size"),
    )

    def step(acc: Column, length: Column) -> Column:
        opens = (acc["size"] == 0) | (acc["size"] + length > max_chars)
        return F.struct(
            F.when(opens, F.array_append(acc["starts"], acc["i"]))
            .otherwise(acc["starts"]).alias("starts"),
            (acc["i"] + 1).alias("i"),
            F.when(length > max_chars, F.lit(0))
            .when(opens, length + 2)
            .otherwise(acc["size"] + length + 2).alias("size"),
        )

    return F.aggregate(lengths, begin, step)["starts"]


def paragraphs(text: Column) -> Column:
    """Stripped, non-blank paragraphs (separated by a blank line)."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def pack_paragraphs(text: Column, max_chars: int = settings.CHUNK_CHARS) -> Column:
    """Pack paragraphs into chunks of at most `max_chars` characters.

    A paragraph longer than that is kept whole. The fold carries two integers and
    the chunk starts, never the text, so its cost is linear in the document.
    """

    def build(paras: Column) -> Column:
        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda start, k: F.array_join(
                    F.slice(
                        paras, start + 1,
                        F.coalesce(F.get(starts, k + 1), F.size(paras)) - start,
                    ),
                    "\n\n",
                ),
            )

        return let(group_starts(F.transform(paras, F.length), max_chars), cut)

    return let(paragraphs(text), build)


def markdown_sections(text: Column) -> Column:
    """Array of (heading, body), one per ATX heading.

    Lines before the first heading form a section called `preamble`, kept when it
    has text. Works inside one row: a document needs no shuffle to be sectioned.
    """
    space, solid = f"[{WHITESPACE_CLASS}]", f"[^{WHITESPACE_CLASS}]"
    pattern = f"^#{{1,6}}{space}+(.*{solid}){space}*$"

    def build(rows: Column) -> Column:
        marks = F.filter(
            F.transform(rows, lambda line, i: F.when(line.rlike(pattern), i)),
            lambda i: i.isNotNull(),
        )

        def body(start: Column, end: Column) -> Column:
            return strip(F.array_join(F.slice(rows, start + 1, end - start), "\n"))

        def sections(at: Column) -> Column:
            head = F.array(F.struct(
                F.lit("preamble").alias("heading"),
                body(F.lit(0), F.coalesce(F.get(at, F.lit(0)), F.size(rows))).alias("body"),
            ))
            rest = F.transform(at, lambda i, k: F.struct(
                strip(F.regexp_extract(F.get(rows, i), pattern, 1)).alias("heading"),
                body(i + 1, F.coalesce(F.get(at, k + 1), F.size(rows))).alias("body"),
            ))
            return F.filter(
                F.concat(head, rest),
                lambda s: (s["body"] != "") | (s["heading"] != "preamble"),
            )

        return let(marks, sections)

    return let(lines(text), build)
