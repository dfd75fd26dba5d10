"""The append-only reply log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.operators.answers import grade_replies

LOG_COLUMNS = (
    "id bigint, role string, model string, raw string, parsed string, answer string, "
    "correct boolean, parse_failed boolean, seconds double, seq bigint"
)


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The log with its fixed schema. JSON lines: UTF-8, blank lines are skipped."""
    return spark.read.schema(LOG_COLUMNS).format(fmt).load(path)


def append_responses(answered: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append finished answers. Rows with an error are left out, so a later run asks again."""
    finished = answered.where(F.col("error").isNull()) if "error" in answered.columns else answered
    finished.drop("error", "stop").write.mode("append").format(fmt).save(path)


def import_replies(
    replies: DataFrame, key: DataFrame, questions: DataFrame, role: str, model: str
) -> DataFrame:
    """Replies of another run, given by row number, as graded log rows. ``key`` maps the
    row number to the question id."""
    named = replies.join(key.select("row", "id"), "row").select(
        "id", F.lit(role).alias("role"), F.lit(model).alias("model"), F.col("reply").alias("raw")
    )
    return grade_replies(named, questions)
