"""The reply log: pending work, parsing, grading, last answers, summaries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tollgate.defaults import ROWS_PER_BUCKET
from tollgate.functions.outcomes import need_strong, share
from tollgate.functions.replies import chosen_letter, latin_labels, reply_labels
from tollgate.operators.ordered import exact_quantiles
from tollgate.session import measured
from tollgate.sources.replies import StopCalls as StopCalls, call

ROLES = ("weak", "strong")
ANSWER_SCHEMA = "id bigint, model string, raw string, seconds double, error string, stop boolean"


def role_of(model: Column, pair: Mapping[str, str]) -> Column:
    """The role of a model in the current pair, null for any other model."""
    return F.when(model == pair["weak"], "weak").when(model == pair["strong"], "strong")


def pending(questions: DataFrame, responses: DataFrame, model: str) -> DataFrame:
    """Questions without a reply of this model."""
    # Distinct on the map side first: an id with very many replies is no hot spot.
    done = responses.where(F.col("model") == model).select("id").distinct()
    return questions.join(done, "id", "left_anti")


def parse_answers(replies: DataFrame, raw: str = "raw", n_options: str = "n_options") -> DataFrame:
    """Add ``parsed``: the option letter a reply commits to, or null."""
    labels = reply_labels(F.col(raw))
    staged = replies.withColumns(labels).withColumns(latin_labels())
    return staged.withColumn("parsed", chosen_letter(F.col(n_options))).drop(*labels)


def grade(parsed: DataFrame) -> DataFrame:
    """Add ``correct`` and ``parse_failed``; no letter counts as wrong."""
    return parsed.withColumns(
        {
            "correct": F.coalesce(F.col("parsed") == F.col("answer"), F.lit(False)),
            "parse_failed": F.col("parsed").isNull(),
        }
    )


def answer_key(questions: DataFrame) -> DataFrame:
    return questions.select(
        "id", F.col("answer_letter").alias("answer"), F.size("options").cast("bigint").alias("n_options")
    )


def grade_replies(replies: DataFrame, questions: DataFrame) -> DataFrame:
    """Attach the answer key to raw replies, parse and grade them. Replies to unknown ids are left out:
    ``unknown_replies`` has them."""
    return grade_by_key(replies, answer_key(questions))


def grade_by_key(replies: DataFrame, key: DataFrame) -> DataFrame:
    """``grade_replies`` with the questions' ``answer_key``."""
    return grade(parse_answers(replies.join(key, "id")))


def unknown_replies(replies: DataFrame, questions: DataFrame) -> DataFrame:
    """Replies whose id the question table does not hold."""
    return replies.join(questions.select("id"), "id", "left_anti")


def answer_pending(
    todo: DataFrame,
    make_answer: Callable[[], Callable[[str], str]],
    model: str,
    attempts: int = 3,
    wait_seconds: float = 5.0,
) -> DataFrame:
    """Ask a model for each prompt, as (id, model, raw, seconds, error, stop).

    ``make_answer`` runs once per partition and returns the function that maps a prompt
    to a reply. A failed call is tried again after a growing wait and then reported in
    ``error``; the next rows go on. ``StopCalls`` marks its row and the rest of the
    partition. For calls that must not be paid twice see ``sources/replies``.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make_answer()
        stopped = None
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["id"], batch["prompt"]):
                raw, error, started = None, stopped, time.perf_counter()
                if not stopped:
                    raw, error, stop = call(answer, prompt, attempts, wait_seconds)
                    stopped = error if stop else None
                seconds = round(time.perf_counter() - started, 2)
                rows.append((key, model, raw, seconds, error, stopped is not None))
            yield pd.DataFrame(rows, columns=["id", "model", "raw", "seconds", "error", "stop"])

    return todo.select("id", "prompt").mapInPandas(ask, ANSWER_SCHEMA)


def current_responses(responses: DataFrame, sample: DataFrame, pair: Mapping[str, str]) -> DataFrame:
    """Replies of the current pair to sampled questions, with the role re-derived."""
    current = responses.where(F.col("model").isin(*pair.values()))
    kept = current.join(sample.select("id"), "id", "left_semi")
    return kept.withColumn("role", role_of(F.col("model"), pair))


def response_summary(current: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per role, over all logged replies: answered, accuracy, parse failures, median seconds. The replies are
    parsed and graded once, for counts by duration, from which all of it follows."""
    cells = current.groupBy("role", "model", "seconds").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("right"), F.count_if("parse_failed").alias("failed")
    )
    cells = measured(cells)
    counts = cells.groupBy("role", "model").agg(
        F.sum("n").alias("answered"),
        F.try_divide(F.sum("right"), F.sum("n")).alias("accuracy"),
        F.sum("failed").alias("parse_failures"),
        F.try_divide(F.sum("failed"), F.sum("n")).alias("parse_failure_rate"),
    )
    medians = exact_quantiles(cells, ["role"], "seconds", {"median_seconds": 0.5}, rows_per_bucket, F.col("n"))
    return counts.join(medians, "role", "left")


def last_answers(current: DataFrame, value: str = "correct", order: str = "seq") -> DataFrame:
    """One row per question with the last answer of each role."""
    picks = []
    for role in ROLES:
        mine = F.col("role") == role
        picks.append(F.max_by(F.when(mine, F.col(value)), F.when(mine, F.col(order))).alias(f"{role}_{value}"))
    return current.groupBy("id").agg(*picks)


def build_routing_table(
    sample: DataFrame, responses: DataFrame, pair: Mapping[str, str], order: str = "seq"
) -> DataFrame:
    """(id, subject, prompt, weak_correct, strong_correct) for questions both models answered."""
    wide = last_answers(current_responses(responses, sample, pair), "correct", order)
    both = wide.dropna(subset=["weak_correct", "strong_correct"])
    return sample.select("id", "subject", "prompt").join(both, "id")


def coverage(sample: DataFrame, responses: DataFrame, pair: Mapping[str, str]) -> DataFrame:
    """Which roles answered at all, complete questions, and questions still missing one."""
    roles = last_answers(current_responses(responses, sample, pair))
    joined = sample.select("id").join(roles, "id", "left")
    weak, strong = F.col("weak_correct").isNotNull(), F.col("strong_correct").isNotNull()
    return joined.agg(
        (F.count_if(weak) > 0).alias("has_weak"),
        (F.count_if(strong) > 0).alias("has_strong"),
        F.count_if(weak & strong).alias("complete"),
        F.count_if(~(weak & strong)).alias("missing"),
    )


def answer_letters(current: DataFrame, order: str = "seq") -> DataFrame:
    """Last letter, key and result per question and role side by side."""
    answered = current.select("id", "role", order, F.struct("parsed", "correct", "answer").alias("last"))
    wide = last_answers(answered, "last", order).dropna(subset=["weak_last", "strong_last"])
    return wide.select(
        "id",
        F.col("weak_last.answer").alias("answer"),
        F.col("weak_last.parsed").alias("weak_letter"),
        F.col("strong_last.parsed").alias("strong_letter"),
        F.col("weak_last.correct").alias("weak_correct"),
        F.col("strong_last.correct").alias("strong_correct"),
    )


def letter_shares(letters: DataFrame) -> DataFrame:
    """Share of rows in which each letter is true, said by weak and said by strong."""
    sides = {"true_share": "answer", "weak_share": "weak_letter", "strong_share": "strong_letter"}
    entries = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("letter")) for k, c in sides.items()])
    counts = letters.select(F.inline(entries)).groupBy("letter").agg(
        *[F.count_if(F.col("side") == k).alias(k) for k in sides]
    )
    # Every row adds one to each side, under some letter or under none: at most six rows here.
    rates = [(F.col(k) / F.sum(k).over(Window.partitionBy())).alias(k) for k in sides]
    return counts.select("letter", *rates).where(F.col("letter").isNotNull())


def letter_bias(letters: DataFrame, favourite: str = "A") -> DataFrame:
    """Accuracy of both models and need rate where the favourite letter is true, where
    it is not, and overall."""
    weak, strong = F.col("weak_correct"), F.col("strong_correct")
    side = F.when(F.col("answer") == favourite, favourite).otherwise("other")
    grouped = letters.withColumn("true_letter", side).rollup("true_letter").agg(
        F.count("*").alias("n"),
        share(weak).alias("weak_acc"),
        share(strong).alias("strong_acc"),
        share(need_strong(weak, strong)).alias("need_strong_rate"),
    )
    return grouped.withColumn("true_letter", F.coalesce("true_letter", F.lit("all")))


def agreement(letters: DataFrame) -> DataFrame:
    """Share of questions on which both models give the same letter."""
    same = F.coalesce(F.col("weak_letter") == F.col("strong_letter"), F.lit(False))
    return letters.agg(F.count("*").alias("n"), share(same).alias("same_letter"))
