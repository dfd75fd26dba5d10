"""Collect answers for what is still pending; can be stopped, die, and run again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from tollgate.operators.answers import answer_key, grade_by_key, pending
from tollgate.operators.quality import with_prompts
from tollgate.session import written
from tollgate.sources.questions import path_exists
from tollgate.sources.replies import StopCalls, ask_durably, committed
from tollgate.sources.responses import append_responses, read_responses

COLUMNS = ("id", "role", "model", "raw", "parsed", "answer", "correct", "parse_failed", "seconds", "seq")


def raw_folder(log_path: str) -> str:
    """Where the replies lie as they came, beside the log."""
    return f"{log_path.rstrip('/')}-raw"


def publish(key: DataFrame, log_path: str, role: str, model: str, seq: int) -> int:
    """Grade the committed replies that the log does not have by the sample's ``answer_key`` and append them; how many there were."""
    spark = key.sparkSession
    replies = committed(spark, raw_folder(log_path)).where(F.col("model") == model)
    if path_exists(spark, log_path):
        logged = read_responses(spark, log_path, "parquet").select("id", "model").distinct()
        replies = replies.join(logged, ["id", "model"], "left_anti")
    graded = grade_by_key(replies, key).withColumns({"role": F.lit(role), "seq": F.lit(seq).cast("bigint")})
    graded = written(graded.select(*COLUMNS), "graded")
    append_responses(graded, log_path)
    return graded.count()


def collect_answers(
    sample: DataFrame,
    log_path: str,
    role: str,
    pair: Mapping[str, str],
    make_answer: Callable[[], Callable[[str], str]],
    seq: int,
    **options,
) -> int:
    """Ask ``pair[role]`` every pending question and append the graded answers.

    ``seq`` orders this run among others in the log. A reply is committed to ``raw_folder`` within the task that
    paid for it, every few replies (see ``sources/replies``); what a run that died has left there is graded
    first and not asked again. Returns the number of answers of this run; raises StopCalls, after grading
    them, when the answer function gave up.
    """
    spark, model = sample.sparkSession, pair[role]
    key = written(answer_key(sample), "key")  # graded by twice; the sample may take work
    publish(key, log_path, role, model, seq)
    todo = pending(sample, read_responses(spark, log_path, "parquet"), model)
    folder = f"{raw_folder(log_path)}/run-{seq}-{uuid.uuid4().hex}"
    outcome = ask_durably(with_prompts(todo), make_answer, model, folder, **options)
    stopped = outcome.agg(F.max("stopped")).first()[0]
    answered = publish(key, log_path, role, model, seq)
    if stopped:
        raise StopCalls("the answer function stopped the run; finished answers are saved")
    return answered
