"""Cleaning, quality gate and profile of a question table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tollgate.defaults import INSTRUCTION, LETTERS
from tollgate.functions import questions as q
from tollgate.functions.letters import letter_index
from tollgate.functions.text import strip

OPTION_COLUMNS = tuple(f"Option {i}" for i in range(1, 6))


def clean_questions(raw: DataFrame, options: Sequence[str] = OPTION_COLUMNS) -> DataFrame:
    """Raw table to (id, subject, question, context, options, answer_letter)."""
    return raw.select(
        F.col("ID").alias("id"),
        q.subject_key(F.col("Subject"), F.col("Level")).alias("subject"),
        strip(F.col("Question")).alias("question"),
        F.col("Context").alias("context"),
        q.options_array(*[F.col(f"`{c}`") for c in options]).alias("options"),
        strip(F.col("`Answer Key`")).alias("answer_letter"),
    )


def quality_gate(questions: DataFrame) -> DataFrame:
    """One row of violation counts; all zero for a sound table."""
    index, size = letter_index(F.col("answer_letter")), F.size("options")
    return questions.agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count_distinct("id")).alias("repeated_id"),
        F.count_if(index.isNull()).alias("bad_letter"),
        F.count_if(size < 2).alias("too_few_options"),
        F.count_if(size > len(LETTERS)).alias("too_many_options"),
        F.count_if(index > size).alias("answer_without_option"),
    )


def assert_quality(questions: DataFrame) -> DataFrame:
    """The table itself, or ValueError naming the violations."""
    counts = quality_gate(questions).first().asDict()
    broken = {k: v for k, v in counts.items() if k != "n" and v}
    if broken:
        raise ValueError(f"question table is not sound: {broken}")
    return questions


def _ambiguous() -> Column:
    return q.is_ambiguous(F.col("options"), F.col("answer_letter"))


def drop_ambiguous(questions: DataFrame) -> DataFrame:
    """Drop questions whose right option occurs more than once."""
    return questions.where(~_ambiguous())


def ambiguity(questions: DataFrame) -> DataFrame:
    """How many questions are kept and dropped."""
    return questions.agg(F.count_if(~_ambiguous()).alias("kept"), F.count_if(_ambiguous()).alias("dropped"))


def with_prompts(questions: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    prompt = q.build_prompt(F.col("question"), F.col("options"), F.col("context"), instruction)
    return questions.withColumn("prompt", prompt)


def question_features(questions: DataFrame) -> DataFrame:
    """Add n_options, has_context and prompt_chars (needs a prompt)."""
    return questions.withColumns(
        {
            "n_options": F.size("options").cast("bigint"),
            "has_context": F.col("context").isNotNull(),
            "prompt_chars": F.length("prompt").cast("bigint"),
        }
    )


def split_questions(texts: DataFrame, text: str = "text") -> DataFrame:
    """Free text to ``question`` and ``options``.

    The pair is generated as a row of its own: a filter on the options then stays above
    this step, where as a column the optimizer would evaluate the split once more to
    filter earlier."""
    lines = texts.withColumn("__text", q.text_lines(F.col(text)))
    lines = lines.withColumn("__lines", q.question_lines(F.col("__text")))
    question, options = q.split_question(F.col("__lines"))
    pair = F.array(F.struct(question.alias("question"), options.alias("options")))
    return lines.select(*texts.columns, F.inline(pair))


# Bits of a sketch's index: 4,096 registers, a standard error of 1.04 / sqrt(4096) = 1.6 %.
SKETCH_BITS = 12


def profile_sketches(df: DataFrame, split: str) -> DataFrame:
    """(split, column, n, nulls, sketch) for every other column, in one aggregate. Profiles of parts of a table can
    be stored and merged by ``sketched_profile``."""
    columns = [f for f in df.columns if f != split]
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count("*").alias("n"),
            (F.count("*") - F.count(F.col(f"`{c}`"))).alias("nulls"),
            F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), SKETCH_BITS).alias("sketch"),
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    return df.groupBy(split).agg(*stats).select(split, F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def sketched_profile(sketches: DataFrame, split: str) -> DataFrame:
    """(split, column, n, nulls, distinct_values) of one or more profiles together; distinct values are estimated."""
    merged = sketches.groupBy(split, "column").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch")
    )
    return merged.select(split, "column", "n", "nulls", F.hll_sketch_estimate("sketch").alias("distinct_values"))


def profile_splits(df: DataFrame, split: str, exact: bool = False) -> DataFrame:
    """(split, column, n, nulls, distinct_values) for every other column.

    The exact form counts each (split, column, value) first, so one frequent value is
    one pre-aggregated row; the default uses sketches and a single pass.
    """
    if not exact:
        return sketched_profile(profile_sketches(df, split), split)
    columns = [c for c in df.columns if c != split]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ])
    values = df.select(split, F.inline(cells)).groupBy(split, "column", "value").agg(F.count("*").alias("m"))
    return values.groupBy(split, "column").agg(
        F.sum("m").alias("n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("m"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def sample_summary(questions: DataFrame) -> DataFrame:
    """Rows, distinct subjects and rows with a context."""
    return questions.agg(
        F.count("*").alias("n"),
        F.count_distinct("subject").alias("subjects"),
        F.count_if(F.col("context").isNotNull()).alias("with_context"),
    )
