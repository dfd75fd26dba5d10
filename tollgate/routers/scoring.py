"""Score both evaluation setups out of sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tollgate.operators.sampling import SplitPlan
from tollgate.routers.base import ROUTERS, Router
from tollgate.routers.baselines import LengthRouter, OracleRouter, RandomRouter, length_counts, length_shares
from tollgate.routers.embedding import EmbeddingRouter, with_vectors
from tollgate.routers.regression import fit_balanced, fit_sparse, marks_of, score_of, sparse_scores, weights_of
from tollgate.routers.tfidf import TfidfRouter, gram_counts, packed_by_term, vocabulary
from tollgate.session import measured, spread, written

COLUMNS = ("setup", "router", "fold", "id", "subject", "weak_correct", "strong_correct", "need_strong", "score")


def with_assignment(table: DataFrame, splits: DataFrame | SplitPlan) -> DataFrame:
    """One row per question with its ``part`` in the random setup and its test ``fold`` in
    the unseen one: all that any of the models needs to tell training rows from test rows.
    A plan tells both from the row itself; a stored table of splits has to be joined by id."""
    if isinstance(splits, SplitPlan):
        return splits.assign(table)
    by_id = splits.groupBy("id").agg(
        F.max(F.when(F.col("setup") == "random", F.col("part"))).alias("part"),
        F.max(F.when(F.col("setup") == "unseen_subjects", F.col("fold"))).alias("fold"),
    )
    return table.join(by_id, "id")


def test_rows(assigned: DataFrame) -> DataFrame:
    """Long form of what has to be scored: random test rows, and every row in its fold."""
    places = F.array(
        F.struct(F.lit("random").alias("setup"), F.lit(0).alias("in_fold")),
        F.struct(F.lit("unseen_subjects").alias("setup"), F.col("fold").alias("in_fold")),
    )
    wanted = F.filter(places, lambda p: (p["setup"] != "random") | (F.col("part") == "test"))
    return assigned.select(*[c for c in assigned.columns if c != "fold"], F.inline(wanted)).withColumnRenamed(
        "in_fold", "fold"
    )


def _folds(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("fold").distinct().collect())


def _models(assigned: DataFrame) -> list[tuple[str, int, object, object]]:
    """(setup, fold, training condition, test condition) of each model to be fitted."""
    unseen = [("unseen_subjects", f, F.col("fold") != f, F.col("fold") == f) for f in _folds(assigned)]
    return [("random", 0, F.col("part") == "train", F.col("part") == "test"), *unseen]


def score_splits(table: DataFrame, splits: DataFrame | SplitPlan, name: str, **options) -> DataFrame:
    """Fit a router on each training side and score its test side; long form."""
    assigned = with_assignment(table, splits)
    router = ROUTERS[name](**options)
    if isinstance(router, LengthRouter):
        scored = _length_scores(assigned)
    elif isinstance(router, (RandomRouter, OracleRouter)):
        scored = router.score(test_rows(assigned))
    elif isinstance(router, TfidfRouter):
        scored = _tfidf_scores(assigned, router)
    elif isinstance(router, EmbeddingRouter):
        scored = _embedding_scores(assigned, router)
    else:
        scored = _fitted_scores(assigned, router)
    return scored.withColumn("router", F.lit(name)).select(*COLUMNS)


def _length_scores(assigned: DataFrame) -> DataFrame:
    """All folds at once. Lengths are counted per (part, fold); a model's training counts
    are those of its training part, or of every fold but its own."""
    cells = measured(length_counts(assigned, "part", "fold"))
    random = cells.where(F.col("part") == "train").select(
        F.lit("random").alias("setup"), F.lit(0).alias("fold"), "length", "m"
    )
    folds = F.array(*[F.lit(f) for f in _folds(cells)])
    others = cells.withColumnRenamed("fold", "own").withColumn("fold", F.explode(folds))
    unseen = others.where(F.col("fold") != F.col("own")).select(
        F.lit("unseen_subjects").alias("setup"), "fold", "length", "m"
    )
    rows = test_rows(assigned).withColumn("length", F.length("prompt"))
    asked = rows.select("setup", "fold", "length").distinct()
    shares = measured(length_shares(random.unionByName(unseen), asked, ["setup", "fold"]))
    return rows.join(shares, ["setup", "fold", "length"], "left").drop("length")


def _tfidf_scores(assigned: DataFrame, router: TfidfRouter) -> DataFrame:
    """Terms are counted once per (part, fold), and a model's counts are the sum over its
    training cells; all vocabularies are chosen at once. Texts become counts over the terms of all models once; each model
    then weighs them with its own idf, which is 0 for terms it does not know. All models are fitted in the same passes, and one pass scores every row."""
    sizes = measured(assigned.groupBy("part", "fold").agg(F.count("*").alias("n")))
    texts = spread(assigned, sizes.agg(F.sum("n")).first()[0] or 0)
    models = _models(sizes)
    trained = F.array(*[F.when(is_train, F.lit(m)) for m, (_, _, is_train, _) in enumerate(models)])
    by_model = F.explode(F.array_compact(trained)).alias("model")
    cells = gram_counts(texts, ["part", "fold"]).select("gram", "tf", "df", by_model)
    counts = written(cells.groupBy("model", "gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), "grams")
    n_docs = measured(sizes.select("n", by_model).groupBy("model").agg(F.sum("n").alias("n_docs")))
    # As columns: some hundred thousand rows are large as objects.
    chosen = vocabulary(counts, n_docs, router.max_features, ["model"]).select("model", "gram", "idf").toArrow().combine_chunks()
    terms = chosen["gram"].unique().sort()
    scales = np.zeros((len(models), len(terms)))
    scales[chosen["model"].to_numpy(), pc.index_in(chosen["gram"], value_set=terms).to_numpy()] = chosen["idf"].to_numpy()
    if not scales.any(axis=1).all():
        raise ValueError("no gram occurs in two training texts")
    # Rows of one cell lie side by side, so that a model passes over those that it is not trained on.
    columns = [c for c in texts.columns if c != "prompt"]
    marks = [marks_of("need_strong", [m[k] for m in models]).alias(name) for k, name in ((2, "marks"), (3, "tested"))]
    counts = packed_by_term(texts.sortWithinPartitions("part", "fold").select("*", *marks), terms.to_pylist(), scales)
    weights = weights_of(fit_sparse(counts, scales), scales)

    def score(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for n in numbers for b in counts.batches(n)):
            scores = pa.array(sparse_scores(batch.select(["damped", "tested"]), weights).ravel())
            scores = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(weights)), scores)
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, scores], names=[*columns, "scores"])

    fields = [*[texts.schema[c] for c in columns], T.StructField("scores", T.ArrayType(T.DoubleType()))]
    scored = counts.numbers(texts.sparkSession).mapInArrow(score, T.StructType(fields))
    places = [
        F.when(is_test, F.struct(F.lit(setup).alias("setup"), F.lit(fold).alias("fold"), F.col("scores")[index].alias("score")))
        for index, (setup, fold, _, is_test) in enumerate(models)
    ]
    return scored.select(*[c for c in columns if c != "fold"], F.inline(F.array_compact(F.array(*places))))


def _embedding_scores(assigned: DataFrame, router: EmbeddingRouter) -> DataFrame:
    """All models are fitted in the same passes, and one pass scores every row by the model of its setup and fold."""
    rows = with_vectors(assigned, router.store, router.make_encoder).drop("prompt")
    rows = written(rows, "rows")
    models = _models(rows)
    fitted = fit_balanced(rows, sides=[is_train for _, _, is_train, _ in models])
    here = [(F.col("setup") == setup) & (F.col("fold") == fold) for setup, fold, _, _ in models]
    return test_rows(rows).withColumn("score", score_of(F.col("embedding"), fitted, here))


def _fitted_scores(assigned: DataFrame, router: Router) -> DataFrame:
    """One fit per training side; the scores of the test sides are put together."""
    models = _models(assigned)

    def score(index: int) -> DataFrame:
        setup, fold, is_train, is_test = models[index]
        fitted = router.fit(assigned.where(is_train))
        test = assigned.where(is_test).withColumns({"setup": F.lit(setup), "fold": F.lit(fold)})
        return fitted.score(test).select(*[c for c in COLUMNS if c != "router"])

    return reduce(DataFrame.unionByName, _at_once(score, len(models)))


def _at_once(task: Callable[[int], DataFrame], n: int) -> list[DataFrame]:
    """Submit the fits from several threads: an iteration of one rarely fills the cluster."""
    with ThreadPool(n) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(task), range(n))
