"""Routing decisions at a cut-off, and what goes wrong with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollgate.defaults import MIN_SUBJECT_POSITIVES, MIN_SUBJECT_ROWS, ROWS_PER_BUCKET, WORST_EXAMPLES
from tollgate.functions.outcomes import share
from tollgate.operators.keys import join_null_safe
from tollgate.operators.ordered import auroc, descending, exact_quantiles, running_totals

FEATURES = ("n_options", "has_context", "prompt_chars")


def decide_ranked(ranked: DataFrame, pct: float | Column, rank: str = "rank", n: str = "n") -> DataFrame:
    """Send the top pct percent of rows that know their rank among ``n`` to strong; flag missed and wasted decisions."""
    fraction = pct / 100 if isinstance(pct, Column) else F.lit(pct / 100)
    sent = F.col(rank) <= F.rint(fraction * F.col(n))
    return ranked.withColumn("sent_to_strong", sent).withColumns(
        {
            "missed": ~F.col("sent_to_strong") & F.col("need_strong"),
            "wasted": F.col("sent_to_strong") & F.col("weak_correct"),
        }
    )


def mark_decisions(
    scored: DataFrame,
    pct: float | Column,
    by: Sequence[str] = (),
    score: str = "score",
    tie: Sequence[str] = ("id",),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Send the top pct percent to strong; flag missed and wasted decisions."""
    order = [descending(score), *[F.col(c) for c in tie]]
    run = running_totals(scored, by, order, {"__rank": F.lit(1)}, ["__rank"], rows_per_bucket)
    return decide_ranked(run, pct, "__rank", "__rank_all").drop("__rank", "__rank_all")


def decision_totals(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return decided.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("missed").alias("missed"),
        F.count_if("need_strong").alias("need_strong"),
        F.count_if("wasted").alias("wasted"),
        F.count_if("sent_to_strong").alias("strong_calls"),
    )


def worst_examples(decided: DataFrame, n: int = WORST_EXAMPLES, tie: Sequence[str] = ("id",)) -> DataFrame:
    """The n most confident mistakes: missed with the lowest scores, wasted with the highest; undefined scores are
    the lowest. One pass: each task keeps its first n rows of either kind. Half of the n, rounded up, are missed ones
    if there are so many, and the wasted ones fill up."""
    place, kind = "__place", F.when(F.col("missed"), "missed").when(F.col("wasted"), "wasted")
    low = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(None)), F.lit(float("-inf")))
    confidence = F.when(F.col("missed"), low).otherwise(-low)
    along = Window.partitionBy("error").orderBy(confidence, *tie)
    first = decided.withColumn("error", kind).where(F.col("error").isNotNull())
    first = first.withColumn(place, F.row_number().over(along)).where(F.col(place) <= n)
    n_missed = F.count_if((F.col("error") == "missed") & (F.col(place) <= (n + 1) // 2)).over(Window.partitionBy())
    first = first.withColumn("__missed", n_missed)  # over 2 n rows
    room = F.when(F.col("error") == "missed", F.col("__missed")).otherwise(n - F.col("__missed"))
    return first.where(F.col(place) <= room).drop(place, "__missed")


def with_features(decided: DataFrame, questions: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Attach question features by id; unknown ids keep nulls."""
    return decided.join(questions.select("id", *columns), "id", "left")


def error_patterns(examples: DataFrame, decided: DataFrame) -> DataFrame:
    """Mean of each feature among missed and wasted examples and over all decisions."""
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in FEATURES]
    per_error = examples.groupBy("error").agg(*means)
    return per_error.unionByName(decided.agg(*means).withColumn("error", F.lit("all")))


def subject_failures(
    decided: DataFrame,
    min_rows: int = MIN_SUBJECT_ROWS,
    min_positives: int = MIN_SUBJECT_POSITIVES,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per subject: size, positives, AUROC where there is enough data, and error rates."""
    areas = auroc(decided, ["subject"], rows_per_bucket=rows_per_bucket).select("subject", "auroc")
    rates = decided.groupBy("subject").agg(
        F.count("*").alias("n"),
        F.count_if("need_strong").alias("need_strong"),
        share(F.col("missed")).alias("missed_rate"),
        share(F.col("wasted")).alias("wasted_rate"),
    )
    enough = (
        (F.col("n") >= min_rows)
        & (F.col("need_strong") >= min_positives)
        & (F.col("need_strong") < F.col("n"))
    )
    table = join_null_safe(rates, areas, ["subject"]).withColumn("auroc", F.when(enough, F.col("auroc")))
    return table.orderBy(F.asc_nulls_last("auroc"), "subject")


def hardest(subjects: DataFrame, n: int = 5) -> DataFrame:
    """The ranked subjects which are hardest to route."""
    return subjects.where(F.col("auroc").isNotNull()).orderBy("auroc", "subject").limit(n)


def easiest(subjects: DataFrame, n: int = 5) -> DataFrame:
    return subjects.where(F.col("auroc").isNotNull()).orderBy(F.desc("auroc"), F.desc("subject")).limit(n)


def threshold(
    scored: DataFrame, pct: float, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The score above which pct percent of these rows lie."""
    return exact_quantiles(scored, by, "score", {"threshold": 1 - pct / 100}, rows_per_bucket)


def route(scored: DataFrame, cut: float | Column) -> DataFrame:
    """Add ``role``: strong at or above the cut-off."""
    return scored.withColumn("role", F.when(F.col("score") >= cut, "strong").otherwise("weak"))


def routable(questions: DataFrame) -> DataFrame:
    """Questions with at least two options."""
    return questions.where(F.size("options") >= 2)


def rejected(questions: DataFrame) -> DataFrame:
    return questions.where(F.coalesce(F.size("options"), F.lit(0)) < 2)
