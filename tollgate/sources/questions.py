"""Question tables and the stored sample."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.defaults import SAMPLE_SIZE, SEED
from tollgate.operators.quality import clean_questions
from tollgate.operators.sampling import stratified_sample

RAW_SCHEMA = (
    "ID bigint, Subject string, Level string, Question string, Context string, `Answer Key` string, "
    "`Option 1` string, `Option 2` string, `Option 3` string, `Option 4` string, `Option 5` string, split string"
)


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(RAW_SCHEMA)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    return reader.format(fmt).load(path)


def read_questions(spark: SparkSession, path: str, fmt: str = "parquet", split: str = "test") -> DataFrame:
    """One split of the raw table in the clean schema."""
    return clean_questions(read_raw(spark, path, fmt).where(F.col("split") == split))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there. One that is there but cannot be read is an error, not a missing one."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def materialize_sample(
    questions: DataFrame, path: str, n: int = SAMPLE_SIZE, seed: int = SEED, by: str = "subject"
) -> DataFrame:
    """Draw the sample once; later calls return the stored one."""
    spark = questions.sparkSession
    if not path_exists(spark, path):
        stratified_sample(questions, by, n, seed).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
