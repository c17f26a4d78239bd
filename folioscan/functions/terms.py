"""Tokens, stems and term frequencies."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan import settings
from folioscan.functions.text import let

KEYWORD = r"[A-Za-z][A-Za-z0-9_-]{2,}"


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Accented Latin letters with their base letter; combining marks go last.

    `translate` deletes characters beyond the end of its second argument, which
    removes the marks of decomposed text.
    """
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            accented.append(chr(code))
            plain.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(accented + marks), "".join(plain)


def fold_accents(text: Column) -> Column:
    """Replace accented Latin letters by their base letter."""
    return F.translate(text, *_accent_map())


def folded(text: Column) -> Column:
    """Lower case without accents, as index tokens are cut from it."""
    return fold_accents(F.lower(text))


def lexical_tokens(text: Column, stop_words: tuple[str, ...] = settings.STOP_WORDS) -> Column:
    """Lower-case `[a-z]+` tokens without accents and stop words."""
    found = F.split(folded(text), "[^a-z]+")
    dropped = ("", *stop_words)
    return F.filter(found, lambda token: ~token.isin(*dropped))


def keyword_tokens(text: Column) -> Column:
    """Lower-case identifiers of three characters and more, in text order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({KEYWORD})")), F.lower)
    return F.filter(found, lambda token: ~token.isin(*settings.STOP_WORDS))


def hash_tokens(text: Column) -> Column:
    """Lower-case `[a-z0-9]+` tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of one token array.

    Sorting and cutting runs keeps the count inside the row: no shuffle of tokens
    is needed to get term frequencies.
    """

    def build(ordered: Column) -> Column:
        opens = F.filter(
            F.transform(
                ordered,
                lambda token, i: F.when(
                    (i == 0) | (token != F.get(ordered, i - 1)), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(opens, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(ordered, i).alias("term"),
            (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("tf"),
        )))

    return let(F.sort_array(tokens), build)


# ---- Porter (1980) suffix rules: fixed values --------------------------------
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
# ------------------------------------------------------------------------------

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MEASURE_1 = re.compile(f"^({_C})?{_V}{_C}")
_MEASURE_EQ_1 = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_MEASURE_2 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_HAS_VOWEL = re.compile(f"^({_C})?{_V}")
_SHORT_END = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
_DOUBLE_END = re.compile(r"([^aeiouylsz])\1$")


def _swap_suffix(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    for suffix, replacement in sorted(rules, key=lambda rule: -len(rule[0])):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + replacement if _MEASURE_1.match(base) else word
    return word


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    """Stem of a lower-case ASCII word."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        word = word[:-1] if _MEASURE_1.match(word[:-3]) else word
    else:
        base = re.sub("(ed|ing)$", "", word)
        if base != word and _HAS_VOWEL.match(base):
            word = base
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _DOUBLE_END.search(word):
                word = word[:-1]
            elif _MEASURE_EQ_1.match(word) and _SHORT_END.match(word):
                word += "e"

    if word.endswith("y") and _HAS_VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    word = _swap_suffix(_swap_suffix(word, STEP_2), STEP_3)

    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _MEASURE_2.match(base) and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break

    if word.endswith("e"):
        base = word[:-1]
        if _MEASURE_2.match(base) or (_MEASURE_EQ_1.match(base) and not _SHORT_END.match(base)):
            word = base
    if word.endswith("ll") and _MEASURE_2.match(word[:-1]):
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    """Porter stems of a token array; the cache makes repeated words free."""
    return tokens.map(lambda row: None if row is None else [porter_stem(t) for t in row])
