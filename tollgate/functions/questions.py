"""Expressions over one question: key, options, prompt, free-text split."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tollgate.defaults import INSTRUCTION, LETTERS, NO_LETTER
from tollgate.functions.letters import index_letter, letter_index
from tollgate.functions.text import LINE_BREAK, strip

# What an option line and the gap before an inline option look like.
OPTION_LINE = r"(?U)^\s*[\(\[]?([A-Ea-eأابجده]ـ?)\s*[\)\].:\-]\s*(.+)$"
INLINE_GAP = r"(?U)\s+(?=[\(\[]?[A-E]\s*[\)\].:]\s)"


def subject_key(subject: Column, level: Column) -> Column:
    return F.concat(subject, F.coalesce(F.concat(F.lit(" ("), level, F.lit(")")), F.lit("")))


def options_array(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols))


def correct_option(options: Column, letter: Column) -> Column:
    return F.get(options, letter_index(letter) - 1)


def is_ambiguous(options: Column, letter: Column) -> Column:
    """The text of the right option is also offered under another letter."""
    right = correct_option(options, letter)
    return F.coalesce(F.size(F.filter(options, lambda o: o == right)) > 1, F.lit(False))


def build_prompt(
    question: Column, options: Column, context: Column | None = None, instruction: str = INSTRUCTION
) -> Column:
    """Context (when it holds text), question, lettered options, instruction; one per line. Options
    beyond the last letter are an error."""
    head = F.array(strip(question))
    if context is not None:
        passage = strip(context)
        head = F.when(passage != "", F.array(passage, strip(question))).otherwise(head)
    lettered = F.transform(options, lambda o, i: F.concat(index_letter(i + 1), F.lit(". "), strip(o)))
    prompt = F.array_join(F.concat(head, lettered, F.array(F.lit(instruction))), "\n")
    too_many = F.raise_error(F.concat(F.lit(f"more than {len(LETTERS)} options: "), F.size(options).cast("string")))
    return F.when(F.size(options) > len(LETTERS), too_many).otherwise(prompt)


def text_lines(text: Column) -> Column:
    """The non-blank lines of a text."""
    return F.filter(F.split(strip(text), LINE_BREAK), lambda x: strip(x) != "")


def question_lines(lines: Column) -> Column:
    """Lines as they are; a text on one line is cut before its inline option labels."""
    return F.when(F.size(lines) == 1, F.split(F.get(lines, F.lit(0)), INLINE_GAP)).otherwise(lines)


def split_question(lines: Column) -> tuple[Column, Column]:
    """(question, up to five options) of a text given as lines. The first line always
    belongs to the question; later lines which carry no label are joined to it."""
    first, rest = F.slice(lines, 1, 1), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    is_option = lambda x: F.regexp_like(x, F.lit(OPTION_LINE))
    stem = F.concat(first, F.filter(rest, lambda x: ~is_option(x)))
    question = F.array_join(F.transform(stem, strip), " ")
    options = F.transform(F.filter(rest, is_option), lambda x: strip(F.regexp_extract(x, OPTION_LINE, 2)))
    return question, F.slice(options, 1, len(LETTERS))


def answer_text(options: Column, letter: Column) -> Column:
    return F.coalesce(correct_option(options, letter), F.lit(NO_LETTER))
