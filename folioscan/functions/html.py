"""Text of an HTML page, with regular expressions only."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import text as tx

# What stands in a page without being text or a tag: comments and dropped elements.
INERT = (
    r"<!--.*?(?:-->|\z)"
    r"|<script\b[^>]*+>.*?(?:</script\s*+>|\z)"
    r"|<style\b[^>]*+>.*?(?:</style\s*+>|\z)"
    r"|<noscript\b[^>]*+>.*?(?:</noscript\s*+>|\z)"
)
# Everything that is not a text node, as runs. One alternation, so that whichever opens
# first wins: a tag inside a script and a script inside a comment are both inert. A quoted
# value may hold `>`; with an odd quote the tag ends at its first `>`; a tag that never
# ends is dropped with what follows. All is possessive: no tag is read twice over.
NOT_TEXT = (
    rf"(?is)(?:{INERT}"
    r"|<[!?][^>]*+(?:>|\z)"
    r"|</?[a-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|</?[a-z][^>]*+(?:>|\z))++"
)
TITLE = r"(?is)<title\b[^>]*+>(.*?)</title\s*+>"
NUMBER = r"^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
NAME = r"^&([^\t\n\f <&#;]{1,32};)"
# Names that need no semicolon; the longest one that a text begins with counts.
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
BARE = f"^&({'|'.join(BARE_NAMES)})"


def _code_point(number: Column) -> Column:
    """UTF-8 character of a code point."""
    def byte(value: Column) -> Column:
        return F.lpad(F.hex(value), 2, "0")

    def tail(value: Column) -> Column:
        return byte(F.lit(128) + value % 64)

    n = number
    encoded = (
        F.when(n < 0x80, byte(n))
        .when(n < 0x800, F.concat(byte(192 + F.floor(n / 64)), tail(n)))
        .when(
            n < 0x10000,
            F.concat(byte(224 + F.floor(n / 4096)), tail(F.floor(n / 64)), tail(n)),
        )
        .otherwise(F.concat(
            byte(240 + F.floor(n / 262144)), tail(F.floor(n / 4096)),
            tail(F.floor(n / 64)), tail(n),
        ))
    )
    return F.decode(F.unhex(encoded), "UTF-8")


# Numbers 128 to 159 mean these, where the code page has a character.
WINDOWS_1252 = {
    str(n): bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(128, 160)
}


def _table(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _numbered(body: Column) -> Column:
    """The character of `#65` or `#x41`; leading zeros do not count."""
    hexadecimal = body.rlike("^#[xX]")
    digits = F.regexp_replace(body, "^#[xX]?0*", "")
    fits = F.length(digits) <= F.when(hexadecimal, 6).otherwise(7)
    number = F.when(fits & hexadecimal, F.conv(digits, 16, 10)).when(
        fits, digits).try_cast("bigint")
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    # Control characters and code points that stand for no character vanish.
    nothing = (
        number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
        | number.between(0xFDD0, 0xFDEF) | (number % 0x10000 >= 0xFFFE)
    )
    return F.when(
        number.between(128, 159),
        F.try_element_at(_table(WINDOWS_1252), number.cast("string")),
    ).when(valid & nothing, F.lit("")).when(valid, _code_point(number)).otherwise(F.lit("\ufffd"))


def decode_entities(text: Column) -> Column:
    """Decode character references, each exactly once.

    A name with its semicolon counts as a whole. Otherwise the longest old name that the
    text begins with is decoded, and what follows it stays: `&copyright;` is `©right;`.
    Anything else stays as it is.
    """
    names = _table({name: shown for name, shown in sorted(html5.items()) if name[-1] == ";"})
    bare_names = _table({name: html5[name] for name in BARE_NAMES})

    def piece(part: Column) -> Column:
        def after(length: Column) -> Column:
            return F.substring(part, length + 1, F.length(part))

        number = F.regexp_extract(part, NUMBER, 0)
        name, bare = F.regexp_extract(part, NAME, 1), F.regexp_extract(part, BARE, 1)
        known = F.try_element_at(names, name)
        return (
            F.when(number != "", F.concat(
                _numbered(F.regexp_replace(number, "[&;]", "")), after(F.length(number))))
            .when(known.isNotNull(), F.concat(known, after(F.length(name) + 1)))
            .when(bare != "", F.concat(
                F.try_element_at(bare_names, bare), after(F.length(bare) + 1)))
            .otherwise(part)
        )

    return F.when(
        F.contains(text, F.lit("&")),
        F.array_join(F.transform(F.split(text, "(?=&)"), piece), ""),
    ).otherwise(text)


def title(html: Column) -> Column:
    """Stripped title outside comments and scripts; null when there is none or it is blank."""
    shown = F.regexp_replace(html, f"(?is)(?:{INERT})++", "")
    return F.nullif(
        tx.strip(decode_entities(F.regexp_extract(shown, TITLE, 1))), F.lit("")
    )


def body_text(html: Column) -> Column:
    """Text nodes joined by newlines, at most one blank line between them.

    A run of adjacent tags, comments and dropped elements is one separator: there
    is no text node between its members.
    """
    joined = decode_entities(F.regexp_replace(tx.universal_newlines(html), NOT_TEXT, "\n"))
    return tx.strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))
