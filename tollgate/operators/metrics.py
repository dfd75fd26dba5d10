"""Accuracy against cost: curve, area, APGR, calls needed to reach a target.

Everything comes from one ordered pass: the rows are shuffled once, and each number of
the report is a conditional aggregate over the running gain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tollgate.defaults import FALLBACK_PCT, ROWS_PER_BUCKET, STRONG_PCTS, TARGETS
from tollgate.operators.ordered import descending, running_totals


def cum_gain(
    scored: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    tie: Sequence[str] = ("id",),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``rank``, ``gain`` (running change in right answers when the rows up to here
    go to the strong model) and the group's ``n``, ``n_weak`` and ``n_strong``."""
    weak, strong = F.col("weak_correct").cast("int"), F.col("strong_correct").cast("int")
    run = running_totals(
        scored,
        by,
        [descending(score), *[F.col(c) for c in tie]],
        {"rank": F.lit(1), "gain": strong - weak, "weak": weak, "strong": strong},
        ["rank", "weak", "strong"],
        rows_per_bucket,
    )
    names = {"rank_all": "n", "weak_all": "n_weak", "strong_all": "n_strong"}
    return run.drop("weak", "strong").withColumnsRenamed(names)


def rows_at(pct: float, n: Column) -> Column:
    """How many of n rows make up pct percent, rounding half to even."""
    return F.rint(F.lit(pct / 100) * n).cast("bigint")


def _right_at(pct: float) -> Column:
    """Right answers with the top pct percent sent to strong (an aggregate)."""
    gain = F.max(F.when(F.col("rank") == rows_at(pct, F.col("n")), F.col("gain")))
    return F.max("n_weak") + F.coalesce(gain, F.lit(0))


def _fewest_calls(target: float) -> Column:
    """Smallest rank, 0 included, whose accuracy reaches target * strong accuracy."""
    n = F.col("n")
    goal = F.lit(target) * (F.col("n_strong") / n) - F.lit(1e-12)
    at_none = F.max(F.when(F.col("n_weak") / n >= goal, F.lit(0)))
    later = F.min(F.when((F.col("n_weak") + F.col("gain")) / n >= goal, F.col("rank")))
    return F.coalesce(at_none.cast("bigint"), later)


def _report_name(target: float) -> str:
    return f"pct_strong_for_{int(target * 100)}"


def _summary(gains: DataFrame, by: Sequence[str], pcts: Sequence[int], targets: Sequence[float]) -> DataFrame:
    return gains.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max("n_weak").alias("n_weak"),
        F.max("n_strong").alias("n_strong"),
        F.array(*[_right_at(p) for p in pcts]).alias("right"),
        *[(100 * _fewest_calls(t) / F.max("n")).alias(_report_name(t)) for t in targets],
    )


def _area_sum(right: Column, pcts: Sequence[int]) -> Column:
    """Sum of (step in percent) * (right answers at both ends): 200 * n times the area."""
    parts = [
        F.lit(hi - lo) * (F.get(right, F.lit(i)) + F.get(right, F.lit(i + 1)))
        for i, (lo, hi) in enumerate(zip(pcts, pcts[1:]))
    ]
    return sum(parts[1:], parts[0])


def curve_auc(right: Column, n: Column, pcts: Sequence[int]) -> Column:
    """Trapezoid area over the fraction sent to strong."""
    return _area_sum(right, pcts) / (200 * n)


def apgr(right: Column, n_weak: Column, n_strong: Column, pcts: Sequence[int]) -> Column:
    """(area - weak accuracy) / (strong - weak accuracy); null when strong is no better."""
    gap = n_strong - n_weak
    return F.when(gap > 0, (_area_sum(right, pcts) - 200 * n_weak) / (200 * gap))


def accuracy_curve(
    scored: DataFrame,
    by: Sequence[str] = (),
    pcts: Sequence[int] = STRONG_PCTS,
    score: str = "score",
    tie: Sequence[str] = ("id",),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Accuracy with the top pct percent sent to strong: rows (by..., pct, k, accuracy)."""
    table = _summary(cum_gain(scored, by, score, tie, rows_per_bucket), by, pcts, ())
    points = [
        F.struct(
            F.lit(p).alias("pct"),
            rows_at(p, F.col("n")).alias("k"),
            (F.get("right", F.lit(i)) / F.col("n")).alias("accuracy"),
        )
        for i, p in enumerate(pcts)
    ]
    return table.select(*by, F.inline(F.array(*points)))


def evaluate(
    scored: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    tie: Sequence[str] = ("id",),
    pcts: Sequence[int] = STRONG_PCTS,
    targets: Sequence[float] = TARGETS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One metric row per group: size, accuracies, area, APGR and calls-to-target."""
    return evaluate_gains(cum_gain(scored, by, score, tie, rows_per_bucket), by, pcts, targets)


def evaluate_gains(
    gains: DataFrame,
    by: Sequence[str] = (),
    pcts: Sequence[int] = STRONG_PCTS,
    targets: Sequence[float] = TARGETS,
) -> DataFrame:
    """The same for a table that has been ordered already (see ``cum_gain``)."""
    table = _summary(gains, by, pcts, targets)
    return table.select(
        *by,
        F.col("n").alias("n_test"),
        (F.col("n_weak") / F.col("n")).alias("weak_acc"),
        (F.col("n_strong") / F.col("n")).alias("strong_acc"),
        curve_auc(F.col("right"), F.col("n"), pcts).alias("auc"),
        apgr(F.col("right"), F.col("n_weak"), F.col("n_strong"), pcts).alias("apgr"),
        *[_report_name(t) for t in targets],
    )


def pct_to_reach(
    scored: DataFrame,
    by: Sequence[str] = (),
    targets: Sequence[float] = TARGETS,
    score: str = "score",
    tie: Sequence[str] = ("id",),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Smallest share of strong calls, over all cut-offs, that reaches each target."""
    gains = cum_gain(scored, by, score, tie, rows_per_bucket)
    return _summary(gains, by, (0,), targets).drop("n", "n_weak", "n_strong", "right")


def operating_point(metrics: DataFrame, router: str, column: str = "pct_strong_for_90") -> DataFrame:
    """Share of calls a router needs for the target; the fallback where it never gets there."""
    pct = F.coalesce(F.col(column), F.lit(FALLBACK_PCT))
    return metrics.where(F.col("router") == router).withColumn("pct", pct)
