"""Train the final router and route new questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tollgate.functions.questions import answer_text
from tollgate.operators.decisions import routable, route, threshold
from tollgate.operators.quality import split_questions, with_prompts
from tollgate.operators.metrics import operating_point
from tollgate.routers import ROUTERS, Router
from tollgate.session import written
from tollgate.sources.bundle import Bundle


def train_router(table: DataFrame, router: Router, pct: float) -> Bundle:
    """Fit on all rows; the cut-off sends pct percent of them to strong. The table is read twice, to fit and to score."""
    fitted = router.fit(table)
    scores = written(fitted.score(table).select("score"), "scores")
    cut = threshold(scores, pct).first()["threshold"]
    return Bundle(fitted, float(cut), float(pct), scores.count())


def final_router(table: DataFrame, report: DataFrame, name: str, setup: str = "random", **options) -> Bundle:
    """The router that goes into use: ``name`` fitted on all rows, cut off where the report of the
    evaluation says that it reaches the target."""
    point = operating_point(report.where(F.col("setup") == setup), name).first()
    if point is None:
        raise ValueError(f"the report has no router {name} in setup {setup}")
    return train_router(table, ROUTERS[name](**options), point["pct"])


def prepare(texts: DataFrame, text: str = "text") -> DataFrame:
    """Free texts with at least two options, as questions with a prompt."""
    questions = split_questions(texts, text).withColumn("context", F.lit(None).cast("string"))
    return with_prompts(routable(questions)).drop("context")


def route_batch(
    texts: DataFrame,
    bundle: Bundle,
    cut: float | None = None,
    text: str = "text",
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Question, options, prompt, score and chosen role per text. ``attach`` adds what the
    router needs beyond the prompt, such as the embedding of each row."""
    ready = prepare(texts, text)
    ready = attach(ready) if attach else ready
    return route(bundle.router.score(ready), bundle.threshold if cut is None else cut)


def with_answer_text(answered: DataFrame) -> DataFrame:
    """The chosen option's text, from ``options`` and the ``parsed`` letter."""
    return answered.withColumn("answer_text", answer_text(F.col("options"), F.col("parsed")))
