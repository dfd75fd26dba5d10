"""The jobs from end to end: cleaning, analysis, final router."""

import pytest
from pyspark.sql import functions as F

from tollgate.operators import decisions, metrics
from tollgate.operators.labels import add_label
from tollgate.plans import analyse, clean, route
from tollgate.routers import LengthRouter
from tollgate.sources import tables

RAW = "ID bigint, Subject string, Level string, Question string, Context string, `Answer Key` string, `Option 1` string, `Option 2` string, `Option 3` string, `Option 4` string, `Option 5` string, split string"


def raw_rows():
    good = [(i, "s", None, f" question {i} ", None, "AB"[i % 2], f"x{i}", f"y{i}", None, None, None, "test") for i in range(10)]
    ambiguous = [(10, "s", "hard", "which", "text", "A", "same", "same", "other", None, None, "test")]
    return good + ambiguous + [(11, "s", None, "of the other split", None, "A", "x", "y", None, None, None, "dev")]


def test_cleaning_gates_drops_and_stores(spark, tmp_path):
    raw = str(tmp_path / "raw")
    spark.createDataFrame(raw_rows(), RAW).write.parquet(raw)
    stored, counts = clean.prepare_questions(spark, raw, str(tmp_path / "q"))
    assert sorted(r.id for r in stored.collect()) == list(range(10))
    assert counts.first().asDict() == {"kept": 10, "dropped": 1, "n": 10, "subjects": 1, "with_context": 0}


def test_an_unsound_table_stores_nothing(spark, tmp_path):
    raw = str(tmp_path / "raw")
    spark.createDataFrame([*raw_rows(), raw_rows()[0]], RAW).write.parquet(raw)
    with pytest.raises(ValueError, match="repeated_id"):
        clean.prepare_questions(spark, raw, str(tmp_path / "q"))
    assert not (tmp_path / "q").exists()


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, f"s{i % 6}", f"{'long ' * (i % 7)}question {i}", None, ["x", "y", "z"][: 2 + i % 2], "A") for i in range(240)]
    return spark.createDataFrame(rows, "id long, subject string, question string, context string, options array<string>, answer_letter string")


@pytest.fixture(scope="module")
def table(spark, questions):
    from tollgate.operators.quality import with_prompts

    weak, strong = F.col("id") * 7 % 11 < 5, (F.col("id") % 7 > 2) | (F.col("id") % 5 == 0)
    return add_label(with_prompts(questions).select("id", "subject", "prompt", weak.alias("weak_correct"), strong.alias("strong_correct")))


def test_the_study_stores_what_its_parts_say(spark, table, questions, tmp_path):
    folder = str(tmp_path / "study")
    results = analyse.study(table, questions, folder, ["random", "length", "oracle"], focus="length", replicates=20)
    report = {(r.setup, r.router): r for r in results["metrics"].collect()}
    assert set(report) == {(s, r) for s in ("random", "unseen_subjects") for r in ("random", "length", "oracle")}
    pct = report["random", "length"].pct_strong_for_90
    scores = tables.read_scores(spark, f"{folder}/scores").where("setup = 'random' and router = 'length'")
    marked = decisions.mark_decisions(scores, 50.0 if pct is None else pct, tie=("fold", "id"))
    assert results["failure_totals"].first() == decisions.decision_totals(marked).first()
    worst = decisions.worst_examples(marked)
    assert {r.id for r in results["failure_examples"].collect()} == {r.id for r in worst.collect()}
    stored = spark.read.option("header", True).csv(f"{folder}/failure_examples")
    assert stored.count() == worst.count() and stored.columns == list(analyse.EXAMPLE)
    assert spark.read.option("header", True).csv(f"{folder}/failure_by_subject").count() == 6
    assert results["splits"].count() == 480
    for name in ("label_summary", "chance_warning", "label_stats_by_subject", "split_balance", "metrics", "error_patterns", "hardest_subjects"):
        assert spark.read.option("header", True).csv(f"{folder}/{name}").count() == results[name].count() > 0


def test_the_final_router_is_cut_at_its_operating_point(table):
    report = metrics.evaluate(table.withColumns({"score": F.length("prompt"), "setup": F.lit("random"), "router": F.lit("length")}), ["setup", "router"])
    point = metrics.operating_point(report, "length").first()["pct"]
    bundle = route.final_router(table, report, "length")
    assert (bundle.pct_strong, bundle.n_train) == (point, 240)
    assert bundle.threshold == route.train_router(table, LengthRouter(), point).threshold
    with pytest.raises(ValueError, match="no router"):
        route.final_router(table, report, "oracle")


def test_without_a_report_there_are_no_decisions(table):
    with pytest.raises(ValueError, match="no report"):
        analyse.decided(table, metrics.evaluate(table.withColumns({"score": F.lit(1.0), "setup": F.lit("random"), "router": F.lit("a")}), ["setup", "router"]), "random", "b")


def test_worst_examples_read_the_table_once(spark, table):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = table.select("id", "weak_correct", "need_strong").mapInArrow(count, "id long, weak_correct boolean, need_strong boolean")
    marked = rows.withColumns({"score": (F.col("id") * 37 % 100) / 100.0, "missed": F.col("need_strong") & (F.col("id") % 2 == 0), "wasted": F.col("weak_correct") & (F.col("id") % 2 == 1)})
    got = decisions.worst_examples(marked, 9).collect()
    assert seen.value == 240
    everything = marked.collect()
    missed = sorted((r for r in everything if r.missed), key=lambda r: (r.score, r.id))[:5]
    wasted = sorted((r for r in everything if r.wasted), key=lambda r: (-r.score, r.id))[:4]
    assert sorted(r.id for r in got) == sorted(r.id for r in missed + wasted)
