"""Option letters: index, label and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tollgate.defaults import LETTERS
from tollgate.functions.text import strip

# Arabic option labels and the lengthening mark that may follow one.
ARABIC_LABELS = {"أ": "A", "ا": "A", "ب": "B", "ج": "C", "د": "D", "ه": "E", "هـ": "E"}
TATWEEL = "ـ"


def letter_index(letter: Column) -> Column:
    """1 for A ... 5 for E, null for anything else."""
    return F.when(F.length(letter) == 1, F.nullif(F.position(letter, F.lit(LETTERS)), F.lit(0)))


def index_letter(index: Column) -> Column:
    """The letter at a 1-based position, null outside A..E."""
    return F.nullif(F.substring(F.lit(LETTERS), index, F.lit(1)), F.lit(""))


def is_valid_letter(letter: Column, n_options: Column) -> Column:
    return F.coalesce(letter_index(letter) <= F.coalesce(n_options, F.lit(len(LETTERS))), F.lit(False))


def to_latin(label: Column) -> Column:
    """Arabic labels to A..E; any other label in upper case."""
    label = strip(label)
    names = F.create_map(*[F.lit(x) for pair in ARABIC_LABELS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(names, label),
        F.try_element_at(names, F.rtrim(label, F.lit(TATWEEL))),
        F.upper(label),
    )
