"""Routing tables, splits, scores and rounded result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tollgate.operators.labels import add_label

ROUTING_TABLE = "id bigint, subject string, prompt string, weak_correct boolean, strong_correct boolean"
SPLITS = "setup string, id bigint, fold int, part string"
SCORES = (
    "fold int, id bigint, subject string, weak_correct boolean, strong_correct boolean, "
    "need_strong boolean, score double, setup string, router string"
)


def _reader(spark: SparkSession, schema: str, fmt: str):
    reader = spark.read.schema(schema).format(fmt)
    return reader.options(header=True, multiLine=True, escape='"') if fmt == "csv" else reader


def _writer(df: DataFrame, fmt: str, mode: str):
    writer = df.write.mode(mode).format(fmt)
    return writer.options(header=True, escape='"') if fmt == "csv" else writer


def write_routing_table(table: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    names = [f.strip().split(" ")[0] for f in ROUTING_TABLE.split(",")]
    _writer(table.select(*names), fmt, mode).save(path)


def read_routing_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The table with its flags as booleans and the label added."""
    return add_label(_reader(spark, ROUTING_TABLE, fmt).load(path))


def write_splits(splits: DataFrame, path: str, mode: str = "errorifexists") -> None:
    splits.select("setup", "id", F.col("fold").cast("int"), "part").write.mode(mode).parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLITS).parquet(path)


def write_scores(scores: DataFrame, path: str, mode: str = "append") -> None:
    """Long by (setup, router), which are directories: a report reads only its own rows."""
    scores.write.mode(mode).partitionBy("setup", "router").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).parquet(path)


def rounded(df: DataFrame, decimals: int) -> DataFrame:
    """Every fractional column rounded half to even."""
    kinds = (T.DoubleType, T.FloatType)
    return df.withColumns(
        {f.name: F.bround(f.name, decimals) for f in df.schema.fields if isinstance(f.dataType, kinds)}
    )


def write_result(df: DataFrame, path: str, decimals: int = 4, mode: str = "overwrite") -> None:
    """A result table as CSV with a header."""
    _writer(rounded(df, decimals), "csv", mode).save(path)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _reader(spark, schema, "csv").load(path)
