"""Sentence vectors plus logistic regression; vectors come from a store (see sources/vectors)."""

from __future__ import annotations

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tollgate.routers.base import register_router, save_params
from tollgate.routers.regression import Linear, fit_balanced, score_of
from tollgate.sources.vectors import MakeEncoder, with_encoding


def with_embeddings(df: DataFrame, store: DataFrame) -> DataFrame:
    """Look up each id's vector in one join; an id without one ends the job with an error, so no row is dropped."""
    no_vector = F.raise_error(F.concat(F.lit("no stored vector; fill the store first: id "), F.col("id").cast("string")))
    found = df.join(store.select("id", "embedding"), "id", "left")
    return found.withColumn("embedding", F.coalesce("embedding", no_vector.cast("array<float>")))


def with_vectors(df: DataFrame, store: DataFrame | None, make_encoder: MakeEncoder | None) -> DataFrame:
    if "embedding" in df.columns:
        return df
    return with_encoding(df, make_encoder) if make_encoder else with_embeddings(df, store)


def mean_pool(df: DataFrame, key: str, vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """(key, embedding): the weighted mean of a key's vectors, scaled to unit length.
    Vectors are summed on the map side, so a key with very many vectors is no hot spot."""
    vectors = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    weights = F.col(weight) if weight else F.lit(1.0)
    means = vectors.groupBy(key).agg(Summarizer.mean(F.col("features"), weights).alias("__mean"))
    unit = Normalizer(p=2.0, inputCol="__mean", outputCol="__unit").transform(means)
    return unit.select(key, vector_to_array("__unit").alias("embedding"))


class EmbeddingRouter:
    """Vectors come with the rows, from an encoder of their prompts, or from ``store``, which holds (id, embedding)."""

    def __init__(self, store: DataFrame | None = None, make_encoder: MakeEncoder | None = None):
        self.store, self.make_encoder = store, make_encoder

    def fit(self, train: DataFrame) -> "FittedEmbeddingRouter":
        (model,) = fit_balanced(with_vectors(train, self.store, self.make_encoder))
        return FittedEmbeddingRouter(model, self.store, self.make_encoder)


class FittedEmbeddingRouter:
    def __init__(self, model: Linear, store: DataFrame | None = None, make_encoder: MakeEncoder | None = None):
        self.model, self.store, self.make_encoder = model, store, make_encoder

    def with_encoder(self, make_encoder: MakeEncoder) -> "FittedEmbeddingRouter":
        """The router for new texts: a saved one does not hold its encoder."""
        return FittedEmbeddingRouter(self.model, self.store, make_encoder)

    def score(self, df: DataFrame) -> DataFrame:
        """Score rows that carry an ``embedding``, or encode their prompts, or look it up by id."""
        rows = with_vectors(df, self.store, self.make_encoder)
        scored = rows.withColumn("score", score_of(F.col("embedding"), [self.model], [F.lit(True)]))
        return scored if "embedding" in df.columns else scored.drop("embedding")

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        self.model.save(SparkSession.active(), f"{path}/model")
        save_params(SparkSession.active(), path, "embedding")

    @classmethod
    def load(cls, spark, path: str, params: dict) -> "FittedEmbeddingRouter":
        return cls(Linear.load(spark, f"{path}/model"))


register_router("embedding", EmbeddingRouter, FittedEmbeddingRouter)
