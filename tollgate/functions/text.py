"""Whitespace and character-gram helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip removes, and the line breaks.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def padded_words(text: Column) -> Column:
    """The lower-cased words, each with one blank per side, separated by line breaks; empty without words."""
    words = strip(F.lower(text))
    padded = F.concat(F.lit(" "), F.regexp_replace(words, r"(?U)[\s\x1c-\x1f]+", " \n "), F.lit(" "))
    return F.when(words == "", F.lit("")).otherwise(padded)


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside word boundaries. Each lower-cased word is padded with
    one blank per side; a word shorter than n has no n-gram. Words are separated by a
    line break, which a gram may not contain, so one regex per n walks the whole text,
    capturing n characters ahead and stepping one. ``routers.tfidf`` counts the same grams for whole tables."""
    padded = padded_words(text)
    grams = [F.regexp_extract_all(padded, F.lit(rf"(?=([^\n]{{{n}}}))[^\n]"), F.lit(1)) for n in range(low, high + 1)]
    return F.concat(*grams)
