"""Read one option letter out of a model's reply, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tollgate.functions.letters import is_valid_letter, to_latin
from tollgate.functions.text import strip

# The accepted answer phrases and labels.
LABEL = "[A-Ea-eأابجده]ـ?"
NOT_GLUED = "(?![A-Za-z؀-ۿ])"
ANSWER_PHRASE = (
    r"(?iuU)(?:answer(?:\s+is)?|الإجابة(?:\s+الصحيحة)?(?:\s+هي)?|الاجابة(?:\s+هي)?|الجواب(?:\s+هو)?)"
    rf"\s*[:：\-]?\s*[\(\[]?\s*({LABEL}){NOT_GLUED}"
)
LEADING_LABEL = rf"^({LABEL}){NOT_GLUED}"
CAPITAL_LABEL = "(?<![A-Za-z])([A-E])(?![A-Za-z])"
LEADING_MARKS = "([*\"' "


def reply_labels(reply: Column) -> dict[str, Column]:
    """What the rules look at: the label of the first answer phrase, the label the reply
    starts with, and the distinct capital labels in it. Kept as columns of their own, so
    that each pattern runs once per reply."""
    text = strip(reply)
    return {
        "__stated": F.regexp_extract(text, ANSWER_PHRASE, 1),
        "__leading": F.regexp_extract(F.ltrim(text, F.lit(LEADING_MARKS)), LEADING_LABEL, 1),
        "__capitals": F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITAL_LABEL), F.lit(1))),
    }


def latin_labels() -> dict[str, Column]:
    return {c: to_latin(F.col(c)) for c in ("__stated", "__leading")}


def chosen_letter(n_options: Column) -> Column:
    """The single letter a reply commits to, or null. In order: the first explicit answer
    phrase; null when several different capitals occur; a label the reply starts with; the
    only capital in it. Letters beyond ``n_options`` never count."""
    stated, leading = F.col("__stated"), F.col("__leading")
    named = F.filter("__capitals", lambda x: is_valid_letter(x, n_options))
    return (
        F.when(is_valid_letter(stated, n_options), stated)
        .when(F.size(named) > 1, F.lit(None).cast("string"))
        .when(is_valid_letter(leading, n_options), leading)
        .otherwise(F.get(named, F.lit(0)))
    )
