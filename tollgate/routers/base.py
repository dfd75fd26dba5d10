"""Router contract and registry."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class FittedRouter(Protocol):
    def score(self, df: DataFrame) -> DataFrame: ...

    def save(self, path: str) -> None: ...


class Router(Protocol):
    def fit(self, train: DataFrame) -> FittedRouter: ...


ROUTERS: dict[str, type] = {}
_LOADERS: dict[str, type] = {}


def register_router(name: str, router: type, fitted: type | None = None) -> type:
    """Make a router known by name; ``fitted`` (with a ``load``) allows reloading it."""
    ROUTERS[name] = router
    if fitted is not None:
        _LOADERS[name] = fitted
    return router


def save_params(spark: SparkSession, path: str, kind: str, **params) -> None:
    row = spark.createDataFrame([(kind, json.dumps(params))], "kind string, params string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_router(spark: SparkSession, path: str) -> FittedRouter:
    row = spark.read.parquet(f"{path}/params").first()
    return _LOADERS[row["kind"]].load(spark, path, json.loads(row["params"]))
