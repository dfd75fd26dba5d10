import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def table_of(spark):
    """A table of (doc_id, text) rows with more columns, some named like columns that operators make."""

    def make(rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        extra = {c: F.lit(7) for c in ("part", "size", "target", "row", "spans", "key", "n_words", "block", "component")}
        return df.withColumns(extra | {"source": F.concat(F.lit("s"), F.coalesce(F.col("doc_id"), F.lit(0)) % 3), "n_chars": F.length("text").cast("long")})

    return make
