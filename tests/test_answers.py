import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tollgate.operators import answers
from tollgate.plans.collect import collect_answers
from tollgate.sources import replies
from tollgate.sources.responses import append_responses, read_responses
from tollgate.sources.vectors import upsert_embeddings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR = {"weak": "w1", "strong": "s1"}
LOG = "id long, model string, correct boolean, parse_failed boolean, seconds double, seq long"


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(i, "s", f"question {i}", None, ["x", "y", "z"], "ABC"[i % 3], f"prompt {i}") for i in range(30)]
    return spark.createDataFrame(
        rows, "id long, subject string, question string, context string, options array<string>, answer_letter string, prompt string"
    )


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, "w1", False, False, 1.0, 1), (1, "w1", True, False, 3.0, 5), (1, "s1", False, True, 4.0, 2),
        (2, "w1", True, False, 2.0, 3), (2, "s0", True, False, 9.0, 4), (99, "w1", True, False, 9.0, 6),
    ]
    return spark.createDataFrame(rows, LOG)


def test_pending_is_per_model(sample, log):
    assert {r.id for r in answers.pending(sample, log, "w1").collect()} == set(range(30)) - {1, 2}
    assert {r.id for r in answers.pending(sample, log, "s1").collect()} == set(range(30)) - {1}


def test_last_answer_wins_and_older_models_are_ignored(sample, log):
    table = answers.build_routing_table(sample, log, PAIR).collect()
    assert [(r.id, r.weak_correct, r.strong_correct) for r in table] == [(1, True, False)]
    assert answers.coverage(sample, log, PAIR).first() == (True, True, 1, 29)


def test_summary_counts_every_logged_reply(sample, log):
    rows = answers.response_summary(answers.current_responses(log, sample, PAIR)).collect()
    weak = next(r for r in rows if r.role == "weak")
    assert (weak.answered, weak.median_seconds, weak.parse_failures) == (3, 2.0, 0)
    assert weak.accuracy == pytest.approx(2 / 3)


def flaky(tries):
    """Fails the first calls of each prompt."""

    def make():
        seen = {}

        def answer(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if seen[prompt] < tries:
                raise TimeoutError("try again")
            return "B"

        return answer

    return make


@pytest.mark.parametrize("tries, failed", [(1, 0), (3, 0), (4, 30)])
def test_failed_calls_are_repeated_then_reported(sample, tries, failed):
    asked = answers.answer_pending(sample, flaky(tries), "w1", attempts=3, wait_seconds=0.0)
    assert asked.where(F.col("error").isNotNull()).count() == failed
    assert asked.where("raw = 'B'").count() == 30 - failed


def out_of_credit():
    calls = []

    def answer(prompt):
        calls.append(prompt)
        if len(calls) > 4:
            raise answers.StopCalls("no credit")
        return f"({'ABC'[len(prompt) % 3]})"

    return answer


def test_a_stopped_run_keeps_its_answers_and_is_resumed(spark, sample, tmp_path):
    path = str(tmp_path / "log")
    one = sample.coalesce(1)
    with pytest.raises(answers.StopCalls):
        collect_answers(one, path, "weak", PAIR, out_of_credit, seq=1, wait_seconds=0.0)
    saved = read_responses(spark, path, "parquet")
    assert saved.count() == 4 and {r.role for r in saved.collect()} == {"weak"}
    assert collect_answers(one, path, "weak", PAIR, flaky(1), seq=2, wait_seconds=0.0) == 26
    everything = read_responses(spark, path, "parquet")
    assert everything.count() == 30 == everything.select("id").distinct().count()
    assert collect_answers(one, path, "weak", PAIR, flaky(1), seq=3) == 0


@pytest.fixture
def calls(tmp_path):
    """A folder with an entry for each call; counts and sorts them by prompt."""
    folder = tmp_path / "calls"
    folder.mkdir()

    class Calls:
        path = str(folder)

        def prompts(self):
            return sorted(p.read_text() for p in folder.iterdir())

    return Calls()


def paying(path, dies_at=None, stops_at=None, wait=0.0):
    """Notes each call in a folder that all tasks share; dies or gives up when so many were made."""

    def make():
        import os
        import time
        import uuid

        def answer(prompt):
            made = len(os.listdir(path))
            if dies_at is not None and made >= dies_at:
                os._exit(1)
            if stops_at is not None and made >= stops_at:
                raise answers.StopCalls("no credit")
            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            time.sleep(wait)
            return "B"

        return answer

    return make


def test_a_run_that_dies_pays_for_nothing_twice(spark, sample, tmp_path, calls):
    path = str(tmp_path / "log")
    with pytest.raises(Exception, match="(?i)python worker|abort"):
        collect_answers(sample.coalesce(1), path, "weak", PAIR, paying(calls.path, dies_at=13), seq=1, rows_per_slice=5, commit_rows=1)
    paid = calls.prompts()
    assert len(paid) == 13
    assert collect_answers(sample, path, "weak", PAIR, paying(calls.path), seq=2, rows_per_slice=5) == 17
    assert len(calls.prompts()) == 30 == len(set(calls.prompts()))
    rows = read_responses(spark, path, "parquet").collect()
    assert sorted(r.id for r in rows) == list(range(30)) and {r.raw for r in rows} == {"B"}


def test_a_stop_ends_all_partitions(spark, tmp_path, calls):
    rows = [(i, "s", f"question {i}", None, ["x", "y", "z"], "A") for i in range(400)]
    many = spark.createDataFrame(rows, "id long, subject string, question string, context string, options array<string>, answer_letter string")
    path = str(tmp_path / "log")
    with pytest.raises(answers.StopCalls):
        collect_answers(many, path, "strong", PAIR, paying(calls.path, stops_at=40, wait=0.02), seq=1, rows_per_slice=10)
    made = len(calls.prompts())
    assert 40 <= made <= 60  # a call or two for each of the tasks at work
    assert read_responses(spark, path, "parquet").count() == made
    assert collect_answers(many, path, "strong", PAIR, paying(calls.path), seq=2, rows_per_slice=100) == 400 - made


def test_a_slice_that_is_tried_again_skips_what_it_committed(tmp_path):
    files = replies.SliceFiles(str(tmp_path), 3, commit_rows=2, commit_seconds=1e9)
    assert files.asked() == set()
    for i in (5, 6, 7):
        files.add((i, "m", "A", 0.1, 1.0))
    assert replies.SliceFiles(str(tmp_path), 3, 2, 1e9).asked() == {5, 6}  # the third one waits
    files.commit()
    assert replies.SliceFiles(str(tmp_path), 3, 2, 1e9).asked() == {5, 6, 7}


def test_a_slice_ends_in_few_files_and_always_shows_what_it_committed(tmp_path, monkeypatch):
    monkeypatch.setattr(replies, "MERGE_ROWS", 100)
    files, seen = replies.SliceFiles(str(tmp_path), 3, commit_rows=10, commit_seconds=1e9), []
    write = files.write

    def look():
        seen.append(replies.SliceFiles(str(tmp_path), 3, 1, 1e9).asked())

    def watched(rows):
        look()  # as a run would that begins after this one was killed here
        path = write(rows)
        look()
        return path

    files.write = watched
    for i in range(345):
        files.add((i, "m", "A", 0.1, 1.0))
        if i % 10 == 9:
            assert replies.SliceFiles(str(tmp_path), 3, 1, 1e9).asked() == set(range(i + 1))
    files.close()
    assert replies.SliceFiles(str(tmp_path), 3, 1, 1e9).asked() == set(range(345))
    assert len([p for p in (tmp_path / "slice=3").glob("*.parquet") if p.name[0] != "."]) == 4
    assert len(seen) > 60 and all(a <= b for a, b in zip(seen, seen[1:]))


def test_many_questions_make_larger_slices_not_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replies, "MAX_SLICES", 4)
    monkeypatch.setattr(replies, "SLICES_PER_CORE", 0)
    todo = spark.range(900).selectExpr("id", "concat('prompt ', id) AS prompt")
    rows = replies.ask_durably(todo, flaky(1), "w1", str(tmp_path / "raw/run-1"), rows_per_slice=10).collect()
    assert len(rows) == 4 and sum(r.answered for r in rows) == 900
    saved = replies.committed(spark, str(tmp_path / "raw"))
    assert sorted(r.id for r in saved.collect()) == list(range(900))
    assert len([p for p in (tmp_path / "raw").rglob("*.parquet") if p.name[0] != "."]) == 4


def test_a_run_takes_the_answer_key_from_the_sample_once(spark, sample, tmp_path):
    evaluated = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            evaluated.add(batch.num_rows)
            yield batch

    watched = sample.mapInArrow(seen, sample.schema)
    assert collect_answers(watched, str(tmp_path / "log"), "weak", PAIR, flaky(1), seq=1) == 30
    assert evaluated.value == 60  # the key and the prompts


def test_refused_calls_are_not_repeated():
    tries = []

    def refuse(prompt):
        tries.append(prompt)
        raise answers.StopCalls("no credit")

    assert replies.call(refuse, "p", 5, 0.0) == (None, "StopCalls: no credit", True) and len(tries) == 1


def test_unknown_ids_are_told(spark, sample):
    rows = spark.createDataFrame([(1, "w1", "A"), (77, "w1", "B")], "id long, model string, raw string")
    assert [r.id for r in answers.grade_replies(rows, sample).collect()] == [1]
    assert [r.id for r in answers.unknown_replies(rows, sample).collect()] == [77]


def test_json_log_skips_blank_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1, "model": "w1", "raw": "ب"}\n\n   \n{"id": 2, "model": "w1", "raw": null}\n', encoding="utf-8")
    rows = read_responses(spark, str(tmp_path / "log.jsonl")).orderBy("id").collect()
    assert [(r.id, r.raw) for r in rows] == [(1, "ب"), (2, None)]


def test_rows_with_an_error_are_not_appended(spark, tmp_path):
    df = spark.createDataFrame([(1, "B", None, False), (2, None, "lost", False)], "id long, raw string, error string, stop boolean")
    append_responses(df, str(tmp_path / "log"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [1]


def test_only_missing_vectors_are_encoded(spark, sample, tmp_path):
    path = str(tmp_path / "store")

    def first():
        import numpy as np

        return lambda texts: np.array([[3.0, 4.0]] * len(texts))

    def second():
        import numpy as np

        return lambda texts: np.array([[0.0, 2.0 if t.startswith("query: prompt") else 0.0] for t in texts])

    upsert_embeddings(path, sample.where("id < 10"), first)
    store = upsert_embeddings(path, sample.union(sample), second, batch_size=4)
    rows = {r.id: r.embedding for r in store.collect()}
    assert store.count() == 30
    assert rows[3] == pytest.approx([0.6, 0.8]) and rows[20] == [0.0, 1.0]
