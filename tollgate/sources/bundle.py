"""A trained router together with its cut-off."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tollgate.routers import FittedRouter, load_router


@dataclass
class Bundle:
    router: FittedRouter
    threshold: float
    pct_strong: float
    n_train: int


def save_router(bundle: Bundle, path: str) -> None:
    spark = SparkSession.active()
    bundle.router.save(f"{path}/router")
    row = [(bundle.threshold, bundle.pct_strong, bundle.n_train)]
    table = spark.createDataFrame(row, "threshold double, pct_strong double, n_train bigint")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cutoff")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    row = spark.read.parquet(f"{path}/cutoff").first()
    return Bundle(load_router(spark, f"{path}/router"), *row)
