"""The store of text vectors, filled incrementally."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tollgate.defaults import ENCODE_BATCH, ENCODE_PREFIX
from tollgate.session import written
from tollgate.sources.questions import path_exists

STORE = "id bigint, embedding array<float>"


MakeEncoder = Callable[[], Callable[[Sequence[str]], np.ndarray]]


def with_encoding(
    df: DataFrame,
    make_encoder: MakeEncoder,
    text: str = "prompt",
    batch_size: int = ENCODE_BATCH,
    prefix: str = ENCODE_PREFIX,
) -> DataFrame:
    """All columns and ``embedding``, of unit length; a null text is encoded as an empty one. Needs no join, so new
    texts can be scored in a batch and in a stream. ``make_encoder`` runs once per partition and returns a
    function from a batch of texts to their vectors; each text gets the prefix."""

    @F.pandas_udf("array<float>")
    def vectors_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            texts, out = [prefix + (t or "") for t in batch], []
            for i in range(0, len(texts), batch_size):
                vectors = np.asarray(encoder(texts[i : i + batch_size]), dtype=np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                out += list((vectors / np.where(norms > 0, norms, 1.0)).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return df.withColumn("embedding", vectors_of(F.col(text)))


def encode(df: DataFrame, make_encoder: MakeEncoder, text: str = "prompt", **options) -> DataFrame:
    """(id, embedding) of each row."""
    return with_encoding(df.select("id", text), make_encoder, text, **options).select("id", "embedding")


def read_vectors(spark, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def upsert_embeddings(path: str, questions: DataFrame, make_encoder, text: str = "prompt", **options) -> DataFrame:
    """Encode the ids that are not stored yet, append them, return the whole store."""
    spark = questions.sparkSession
    todo = questions.select("id", text)
    if path_exists(spark, path):
        todo = todo.join(read_vectors(spark, path).select("id"), "id", "left_anti")
    # Encoded once into the shared folder: the store is read here and appended to below.
    fresh = written(encode(todo.dropDuplicates(["id"]), make_encoder, text, **options), "vectors")
    fresh.write.mode("append").parquet(path)
    return read_vectors(spark, path)
