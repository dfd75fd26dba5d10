"""Score all routers in both setups, report, and store what the report rests on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tollgate.defaults import REPLICATES, SEED
from tollgate.operators import bootstrap, decisions, labels, metrics
from tollgate.operators.ordered import auroc_of_ranks
from tollgate.operators.quality import question_features, with_prompts
from tollgate.operators.sampling import SplitPlan, plan_splits, split_balance
from tollgate.routers.scoring import score_splits
from tollgate.session import written
from tollgate.sources.tables import write_result, write_scores, write_splits

SETUPS = ["setup", "router"]
# Ties keep the order of the scored table: by fold, then by id.
TIE = ("fold", "id")
EXAMPLE = ("error", "id", "subject", "score", "weak_correct", "strong_correct", *decisions.FEATURES, "question")


def score_all(table: DataFrame, splits: DataFrame | SplitPlan, routers: Sequence[str], **options) -> DataFrame:
    """Scores of all routers, written once: each later step orders or groups them anew."""
    parts = [score_splits(table, splits, name, **options.get(name, {})) for name in routers]
    return written(reduce(DataFrame.unionByName, parts), "scores")


def ordered_scores(scores: DataFrame) -> DataFrame:
    """The scores in routing order, stored: what the report needs follows from it without another sort."""
    return written(metrics.cum_gain(scores, SETUPS, tie=TIE), "ranked")


def report_of(gains: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The metric row per (setup, router), with its confidence interval and AUROC."""
    table = metrics.evaluate_gains(gains, SETUPS)
    interval = bootstrap.interval(bootstrap.replicate_gains(gains, SETUPS, replicates, seed, TIE), SETUPS)
    areas = auroc_of_ranks(gains, SETUPS).select(*SETUPS, "auroc")
    return table.join(interval, SETUPS, "left").join(areas, SETUPS, "left")


def report(scores: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    return report_of(ordered_scores(scores), replicates, seed)


def decided(gains: DataFrame, evaluated: DataFrame, setup: str, router: str) -> DataFrame:
    """Decisions of one router at its operating point, from the scores in routing order."""
    point = metrics.operating_point(evaluated.where(F.col("setup") == setup), router).first()
    if point is None:
        raise ValueError(f"no report of router {router} in setup {setup}")
    rows = gains.where((F.col("setup") == setup) & (F.col("router") == router))
    return decisions.decide_ranked(rows, point["pct"])


def analyse(table: DataFrame, routers: Sequence[str], seed: int = SEED, **options) -> tuple[DataFrame, DataFrame]:
    """(scores, report) of a labelled routing table."""
    scores = score_all(table, plan_splits(table, seed), routers, **options)
    return scores, report(scores, seed=seed)


def study(
    table: DataFrame,
    questions: DataFrame,
    folder: str,
    routers: Sequence[str],
    focus: str = "embedding",
    seed: int = SEED,
    replicates: int = REPLICATES,
    **options,
) -> dict[str, DataFrame]:
    """The whole analysis of a labelled routing table, stored in ``folder``; what was stored, by name.

    Labels: label_summary, chance_warning, label_stats_by_subject, splits, split_balance. Evaluation: scores, metrics. Failures of
    the router ``focus``: failure_totals, failure_examples and error_patterns on the random split, and on unseen
    subjects failure_by_subject, hardest_subjects and easiest_subjects.
    """
    spark = table.sparkSession
    table = written(table, "table")
    plan = plan_splits(table, seed)
    assignment = plan.splits(table)
    scores = score_all(table, plan, routers, **options)
    gains = ordered_scores(scores)
    evaluated = written(report_of(gains, replicates, seed), "report")
    random = written(decided(gains, evaluated, "random", focus), "decided")
    unseen = written(decided(gains, evaluated, "unseen_subjects", focus), "decided")
    features = written(question_features(with_prompts(questions)).select("id", *decisions.FEATURES, "question"), "features")
    examples = decisions.with_features(decisions.worst_examples(random, tie=TIE), features, (*decisions.FEATURES, "question"))
    examples = written(examples.select(*EXAMPLE), "examples")
    subjects = written(decisions.subject_failures(unseen), "subjects")
    results = {
        "label_summary": labels.label_summary(table),
        "chance_warning": labels.chance_warning(labels.with_option_counts(table, questions)),
        "label_stats_by_subject": labels.subject_stats(table),
        "split_balance": split_balance(table, assignment),
        "metrics": evaluated,
        "failure_totals": decisions.decision_totals(random),
        "failure_examples": examples,
        "error_patterns": decisions.error_patterns(examples, decisions.with_features(random, features)),
        "failure_by_subject": subjects.orderBy(F.asc_nulls_last("auroc"), "subject"),
        "hardest_subjects": decisions.hardest(subjects),
        "easiest_subjects": decisions.easiest(subjects),
    }
    write_splits(assignment, f"{folder}/splits", mode="overwrite")
    write_scores(scores, f"{folder}/scores", mode="overwrite")
    for name, result in results.items():
        write_result(result, f"{folder}/{name}", decimals=4 if name == "metrics" else 3)
    return {"splits": spark.read.parquet(f"{folder}/splits"), "scores": scores, **results}
