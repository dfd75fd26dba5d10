"""Character-gram TF-IDF plus logistic regression.

Text is taken apart twice however many models are fitted: once to count the terms per part
of the split, and once to turn each text into counts over the terms of all models. The terms of a model
are chosen by a threshold on their number, so only they, at most ``max_features`` per model, reach the driver;
the hashed router needs no list of terms at all. Training tables are counted by numpy in the tasks (see ``functions.grams``), as
is the fit, and so are other large tables in files; streams and small tables are scored by expressions and transformers of the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tollgate.defaults import HASH_BUCKETS, MAX_FEATURES, ROWS_PER_BUCKET
from tollgate.functions.grams import KEY_BITS, chunks, murmur3, tallies
from tollgate.functions.text import char_grams, padded_words
from tollgate.operators.keys import join_null_safe
from tollgate.operators.ordered import running_totals
from tollgate.operators.sums import summed
from tollgate.routers.base import register_router, save_params
from tollgate.routers.regression import SPARSE_BATCH_BYTES, Linear, damping, fit_sparse, marks_of, packed_counts, sparse_scores, weights_of
from tollgate.session import known_bytes, measured, spread, written
from tollgate.sources.kept import Kept, keep

MIN_DOCUMENTS = 2
# Size of a table's files from which its texts are taken apart by numpy.
TASK_BYTES = 1 << 20
TEXT = "__words"
_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def text_grams(df: DataFrame, by: Sequence[str] = ("id",), text: str = "prompt") -> DataFrame:
    """(by..., gram, n): how often each gram occurs in the texts of a key. The texts of a key are brought together, by a break
    that no gram crosses, so only texts are shuffled, never grams."""
    keys = list(by)
    texts = df.groupBy(*keys).agg(F.array_join(F.collect_list(padded_words(F.col(text))), "\n").alias(TEXT))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in chunks(batch.column(TEXT).to_pylist()):
                for found in tallies(part):
                    own = batch.select(keys).take(pa.array(start + found.row)).columns
                    yield pa.RecordBatch.from_arrays([*own, found.grams.take(pa.array(found.gram)), pa.array(found.count)], names=[*keys, "gram", "n"])

    added = [T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())]
    return texts.mapInArrow(count, T.StructType([texts.schema[k] for k in keys] + added))


def gram_counts(df: DataFrame, by: Sequence[str] = (), text: str = "prompt") -> DataFrame:
    """(gram, by..., tf, df): occurrences and number of texts. Tasks add up some hundred texts at a time, so
    only their sums are grouped."""
    keys = list(by)
    texts = df.select(*keys, padded_words(F.col(text)).alias(TEXT))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: dict[tuple, int] = {}
            each = zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * batch.num_rows
            cell = np.array([cells.setdefault(key, len(cells)) for key in each], dtype=np.int64)
            order = np.argsort(cell, kind="stable")  # the rows of a cell side by side
            batch, cell = batch.take(pa.array(order)), cell[order]
            for start, part in chunks(batch.column(TEXT).to_pylist()):
                for found in tallies(part):
                    if not len(found.gram):
                        continue
                    mine = cell[start + found.row]
                    first = np.flatnonzero((np.diff(found.gram, prepend=-1) != 0) | (np.diff(mine, prepend=-1) != 0))
                    tf, n = np.add.reduceat(found.count, first), np.diff(first, append=len(mine))
                    own = batch.select(keys).take(pa.array(start + found.row[first])).columns
                    columns = [found.grams.take(pa.array(found.gram[first])), *own, pa.array(tf), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", *keys, "tf", "df"])

    sums = [T.StructField("tf", T.LongType()), T.StructField("df", T.LongType())]
    schema = T.StructType([T.StructField("gram", T.StringType()), *[texts.schema[k] for k in keys], *sums])
    return texts.mapInArrow(count, schema).groupBy("gram", *by).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(
    counts: DataFrame,
    n_docs: int | DataFrame,
    max_features: int = MAX_FEATURES,
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(by..., gram, tf, df, idf) of the most frequent grams found in at least two texts, ties by gram; idf is
    smoothed: ln((1 + n) / (1 + df)) + 1. ``n_docs`` is a number, or (by..., n_docs).

    The terms are not sorted: how many have which tf tells the tf at which the limit is reached, and
    only the terms with just that tf are put in order. ``counts`` is read several times."""
    by = list(by)
    kept = counts.where(F.col("df") >= MIN_DOCUMENTS)
    sizes = kept.groupBy(*by, "tf").agg(F.count("*").alias("n"))
    run = running_totals(sizes, by, [-F.col("tf")], {"upto": F.col("n")}, rows_per_bucket=rows_per_bucket)
    last = F.max(F.when(F.col("upto") >= max_features, F.struct("tf", (F.col("upto") - F.col("n")).alias("before"))))
    limits = run.groupBy(*by).agg(last.alias("__last"))
    if by:
        kept = join_null_safe(kept, measured(limits), by, "left")
    else:
        row = limits.first()["__last"]
        kind = T.StructType([T.StructField("tf", T.LongType()), T.StructField("before", T.LongType())])
        value = F.struct(F.lit(row["tf"]).alias("tf"), F.lit(row["before"]).alias("before")) if row else F.lit(None)
        kept = kept.withColumn("__last", value.cast(kind))
    at, columns = F.col("__last.tf"), [*by, "gram", "tf", "df"]
    above = kept.where(at.isNull() | (F.col("tf") > at)).select(*columns)
    ties = kept.where(F.col("tf") == at).select(*columns, F.col("__last.before").alias("__before"))
    ties = running_totals(ties, by, [F.col("gram")], {"__place": F.lit(1)}, rows_per_bucket=rows_per_bucket)
    ties = ties.where(F.col("__before") + F.col("__place") <= max_features).select(*columns)
    chosen = above.unionByName(ties)
    if isinstance(n_docs, DataFrame):
        chosen, n = join_null_safe(chosen, n_docs, by), F.col("n_docs")
    else:
        n = F.lit(n_docs)
    idf = F.log((1.0 + n) / (1 + F.col("df"))) + 1
    return chosen.select(*columns, idf.alias("idf"))


Places = Callable[[pa.StringArray], np.ndarray]


def _entries(batch: pa.RecordBatch, places: Places, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of rows, row, place, count) for each chunk of the texts of a batch, in the order of (row, place). ``places`` gives
    the place of each gram, negative if it has none; grams with one place are counted together."""
    for start, part in chunks(batch.column(TEXT).to_pylist()):
        cells, counts = [], []
        for found in tallies(part):
            place = places(found.grams).astype(np.int64)[found.gram]
            known = place >= 0
            cells.append(found.row[known] * size + place[known])
            counts.append(found.count[known])
        cell, tf = np.concatenate(cells), np.concatenate(counts).astype(np.int64)
        bits = int(tf.max(initial=1)).bit_length()
        if (len(part) * size).bit_length() + bits <= KEY_BITS:  # one sort of numbers
            both = np.sort((cell << bits) | tf)
            cell, tf = both >> bits, both & ((1 << bits) - 1)
        else:
            order = np.argsort(cell)
            cell, tf = cell[order], tf[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        tf = np.add.reduceat(tf, first) if len(first) else tf
        yield start, len(part), *np.divmod(cell[first], size), tf


def _by_term(terms: Sequence[str]) -> tuple[Places, int]:
    known = pa.array(list(terms), pa.string())
    return lambda grams: pc.fill_null(pc.index_in(grams, value_set=known), -1).to_numpy(), len(known)


def _by_hash(buckets: int) -> tuple[Places, int]:
    return lambda grams: murmur3(grams) % buckets, buckets


def _with_texts(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", padded_words(F.col(text)).alias(TEXT))


def _damped(df: DataFrame, places: Places, size: int, text: str) -> DataFrame:
    """Add ``damped``, a sparse vector of 1 + ln(tf)."""
    columns = df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows, row, place, tf in _entries(batch, places, size):
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32))
                indices = pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32)))
                values = pa.ListArray.from_arrays(ends, pa.array(damping(tf)))
                kind, width = np.zeros(rows, dtype=np.int8), np.full(rows, size, dtype=np.int32)
                vectors = pa.StructArray.from_arrays([pa.array(kind), pa.array(width), indices, values], names=["type", "size", "indices", "values"])
                own = batch.slice(start, rows).select(columns).columns
                yield pa.RecordBatch.from_arrays([*own, vectors], names=[*columns, "damped"])

    return _with_texts(df, text).mapInArrow(count, T.StructType([*df.schema.fields, T.StructField("damped", VectorUDT())]))


def _packed(df: DataFrame, places: Places, size: int, scales: np.ndarray, text: str) -> Kept:
    """The rows with ``damped`` as ``COUNTS`` in place of the text, to be fitted with the same scales; an entry takes three bytes instead of twelve."""
    columns = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows, row, place, tf in _entries(batch, places, size):
                own = batch.slice(start, rows).select(columns).columns
                yield pa.RecordBatch.from_arrays([*own, packed_counts(row, place, tf, rows, scales)], names=[*columns, "damped"])

    return keep(_with_texts(df, text).drop(text), count, "counts")


def packed_by_term(df: DataFrame, terms: Sequence[str], scales: np.ndarray, text: str = "prompt") -> Kept:
    return _packed(df, *_by_term(terms), scales, text)


def packed_by_hash(df: DataFrame, scales: np.ndarray, text: str = "prompt") -> Kept:
    return _packed(df, *_by_hash(scales.shape[1]), scales, text)


def texts_by_hash(df: DataFrame, buckets: int, text: str = "prompt") -> np.ndarray:
    """In how many texts each bucket occurs."""
    places, size = _by_hash(buckets)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.bincount(place, minlength=size) for _, _, _, place, _ in _entries(batch, places, size)]
        return np.sum(found, axis=0, dtype=float) if found else np.zeros(size)

    return summed(df.select(padded_words(F.col(text)).alias(TEXT)), count, (size,), batch_bytes=SPARSE_BATCH_BYTES)


def _scored(df: DataFrame, places: Places, idf: Sequence[float], model: Linear, text: str) -> DataFrame:
    """Add ``score`` by numpy in the tasks."""
    columns, scales = df.columns, np.array([idf])
    weights = weights_of([model], scales)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows, row, place, tf in _entries(batch, places, scales.shape[1]):
                marks = pa.FixedSizeListArray.from_arrays(pa.array(np.ones(2 * rows, dtype=np.int8)), 2)
                packed = pa.RecordBatch.from_arrays([packed_counts(row, place, tf, rows, scales), marks], names=["counts", "marks"])
                own = batch.slice(start, rows).select(columns).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array(sparse_scores(packed, weights)[:, 0])], names=[*columns, "score"])

    return _with_texts(df, text).mapInArrow(score, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def damped_by_term(df: DataFrame, terms: Sequence[str], text: str = "prompt") -> DataFrame:
    """``damped_counts`` of a large table, by numpy in the tasks."""
    return _damped(df, *_by_term(terms), text)


def damped_by_hash(df: DataFrame, buckets: int = HASH_BUCKETS, text: str = "prompt") -> DataFrame:
    """``hashed_counts`` of a large table."""
    return _damped(df, *_by_hash(buckets), text)


def _dampened(counts: str) -> Column:
    """1 + ln(tf) of a sparse vector of counts. Vectors have no such transformer, so the parts of the
    vector are taken out, changed, and put together again by way of its plain form."""
    parts = F.unwrap_udt(F.col(counts))
    values = F.transform(parts["values"], lambda tf: 1 + F.log(tf))
    plain = F.struct(parts["type"].alias("type"), parts["size"].alias("size"), parts["indices"].alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(plain.alias("v"))), _VECTOR)["v"]


def _transformed(df: DataFrame, counter, text: str) -> DataFrame:
    counted = counter.transform(df.withColumn("__grams", char_grams(F.col(text)))).drop("__grams")
    return counted.withColumn("damped", _dampened("__tf")).drop("__tf")


def in_tasks(df: DataFrame) -> bool:
    """Whether the texts of ``df`` are worth numpy in the tasks: a table in files that are known to be large. The transformers take
    some ten times the CPU time for a text, but need no Python worker, so they serve streams and small tables."""
    size = known_bytes(df)
    return size is not None and size >= TASK_BYTES


def damped_counts(df: DataFrame, terms: Sequence[str], text: str = "prompt") -> DataFrame:
    """Add ``damped``: 1 + ln(tf) of each term that occurs in the text."""
    if in_tasks(df):
        return damped_by_term(df, terms, text)
    return _transformed(df, CountVectorizerModel.from_vocabulary(list(terms), inputCol="__grams", outputCol="__tf"), text)


def hashed_counts(df: DataFrame, buckets: int = HASH_BUCKETS, text: str = "prompt") -> DataFrame:
    """The same for all terms, each counted in one of ``buckets`` places by its hash."""
    if in_tasks(df):
        return damped_by_hash(df, buckets, text)
    return _transformed(df, HashingTF(numFeatures=buckets, inputCol="__grams", outputCol="__tf"), text)


def weighted_features(damped: DataFrame, idf: Sequence[float]) -> DataFrame:
    """``damped`` times idf, at unit length, as ``features``. A term with idf 0 is switched
    off, so one set of counts serves models with different vocabularies."""
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="damped", outputCol="__weighted")
    unit = Normalizer(p=2.0, inputCol="__weighted", outputCol="features")
    return unit.transform(weigh.transform(damped)).drop("damped", "__weighted")


def sparse_score(rows: DataFrame, model: Linear, features: str = "features") -> DataFrame:
    """Add ``score`` in place of the features: the logistic function of their weighted sum."""
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(model.coefficients), inputCol=features, outputCol="__products")
    values = F.unwrap_udt("__products")["values"]
    total = F.aggregate(values, F.lit(float(model.intercept)), lambda s, x: s + x)
    return weigh.transform(rows).withColumn("score", 1 / (1 + F.exp(-total))).drop("__products", features)


class TfidfRouter:
    def __init__(self, max_features: int = MAX_FEATURES):
        self.max_features = max_features

    def idf_of_terms(self, counts: DataFrame, n_docs: int) -> dict[str, float]:
        """The vocabulary with its idf, at most ``max_features`` terms, most frequent first."""
        rows = vocabulary(counts, n_docs, self.max_features).collect()
        if not rows:
            raise ValueError("no gram occurs in two training texts")
        return {r["gram"]: r["idf"] for r in sorted(rows, key=lambda r: (-r["tf"], r["gram"]))}

    def fit(self, train: DataFrame) -> "FittedTfidfRouter":
        n = train.count()
        train = spread(train.select("prompt", marks_of("need_strong", [F.lit(True)]).alias("marks")), n)
        idf = self.idf_of_terms(written(gram_counts(train), "grams"), n)
        scales = np.array([list(idf.values())])
        (model,) = fit_sparse(packed_by_term(train, list(idf), scales), scales)
        return FittedTfidfRouter(list(idf), list(idf.values()), model)


class FittedTfidfRouter:
    def __init__(self, terms: list[str], idf: list[float], model: Linear):
        self.terms, self.idf, self.model = terms, idf, model

    def score(self, df: DataFrame) -> DataFrame:
        if in_tasks(df):
            return _scored(df, _by_term(self.terms)[0], self.idf, self.model, "prompt")
        return sparse_score(weighted_features(damped_counts(df, self.terms), self.idf), self.model)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        vocab = spark.createDataFrame(rows, "position int, gram string, idf double")
        vocab.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.model.save(spark, f"{path}/model")
        save_params(spark, path, "tfidf")

    @classmethod
    def load(cls, spark: SparkSession, path: str, params: dict) -> "FittedTfidfRouter":
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("position").collect()
        model = Linear.load(spark, f"{path}/model")
        return cls([r["gram"] for r in rows], [r["idf"] for r in rows], model)


class HashedTfidfRouter:
    """TF-IDF without a vocabulary: for texts whose terms should not pass the driver. A bucket's document count
    gives its idf; buckets found in a single text are left out."""

    def __init__(self, buckets: int = HASH_BUCKETS):
        self.buckets = buckets

    def fit(self, train: DataFrame) -> "FittedHashedTfidfRouter":
        n = train.count()
        train = spread(train.select("prompt", marks_of("need_strong", [F.lit(True)]).alias("marks")), n)
        # Read twice: what ``train`` is made from, such as a join that moves the texts, is then done once.
        train = written(train, "training")
        found = texts_by_hash(train, self.buckets)
        idf = [math.log((1 + n) / (1 + df)) + 1 if df >= MIN_DOCUMENTS else 0.0 for df in found.tolist()]
        if not any(idf):
            raise ValueError("no gram occurs in two training texts")
        scales = np.array([idf])
        (model,) = fit_sparse(packed_by_hash(train, scales), scales)
        return FittedHashedTfidfRouter(idf, model)


class FittedHashedTfidfRouter:
    def __init__(self, idf: list[float], model: Linear):
        self.idf, self.model = idf, model

    def score(self, df: DataFrame) -> DataFrame:
        if in_tasks(df):
            return _scored(df, _by_hash(len(self.idf))[0], self.idf, self.model, "prompt")
        return sparse_score(weighted_features(hashed_counts(df, len(self.idf)), self.idf), self.model)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = spark.createDataFrame([(self.idf,)], "idf array<double>")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/idf")
        self.model.save(spark, f"{path}/model")
        save_params(spark, path, "tfidf_hashed")

    @classmethod
    def load(cls, spark: SparkSession, path: str, params: dict) -> "FittedHashedTfidfRouter":
        return cls(spark.read.parquet(f"{path}/idf").first()["idf"], Linear.load(spark, f"{path}/model"))


register_router("tfidf", TfidfRouter, FittedTfidfRouter)
register_router("tfidf_hashed", HashedTfidfRouter, FittedHashedTfidfRouter)
