"""From a raw question table to the sound one that is sampled and asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.operators.quality import ambiguity, assert_quality, drop_ambiguous, sample_summary
from tollgate.session import written
from tollgate.sources.questions import read_questions


def sound_questions(questions: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Gate, drop what is ambiguous, store; (the stored table, one row of counts).

    A table that is not sound stores nothing and ends with an error that names the violations: an ambiguous
    question is dropped, but a repeated id or an answer without its option is a mistake of the source."""
    questions = written(questions, "questions")  # read by the gate, the counts and the filter
    counts = ambiguity(assert_quality(questions))
    drop_ambiguous(questions).write.mode("errorifexists").parquet(path)
    stored = questions.sparkSession.read.schema(questions.schema).parquet(path)
    row = {**counts.first().asDict(), **sample_summary(stored).first().asDict()}
    return stored, questions.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} bigint" for c in row))


def prepare_questions(spark: SparkSession, raw_path: str, path: str, fmt: str = "parquet", split: str = "test") -> tuple[DataFrame, DataFrame]:
    """Read one split of the raw table, clean it, and go on as ``sound_questions``."""
    return sound_questions(read_questions(spark, raw_path, fmt, split), path)
