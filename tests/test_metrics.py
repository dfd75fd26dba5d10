import math

import pytest

from tollgate.operators import decisions, metrics

PCTS = [0, 20, 40, 60, 80, 100]


@pytest.fixture(scope="module")
def five(spark):
    """In routing order 4, 2, 0, 3, 1 the strong model wins, wins, loses, wins, changes nothing."""
    rows = [(0, True, False, 0.5), (1, True, True, 0.2), (2, False, True, 0.7), (3, False, True, 0.4), (4, False, True, 0.8)]
    return spark.createDataFrame(rows, "id long, weak_correct boolean, strong_correct boolean, score double")


def test_curve_by_hand(five):
    curve = {r.pct: r.accuracy for r in metrics.accuracy_curve(five, pcts=PCTS).collect()}
    assert curve == {0: 0.4, 20: 0.6, 40: 0.8, 60: 0.6, 80: 0.8, 100: 0.8}


def test_area_apgr_and_calls_by_hand(five):
    # Trapezoids of width 0.2: 0.1 + 0.14 + 0.14 + 0.14 + 0.16 = 0.68; (0.68 - 0.4) / (0.8 - 0.4) = 0.7.
    m = metrics.evaluate(five, pcts=PCTS, targets=(0.75, 1.0, 1.2)).first()
    assert m.n_test == 5 and (m.weak_acc, m.strong_acc) == (0.4, 0.8)
    assert m.auc == pytest.approx(0.68) and m.apgr == pytest.approx(0.7)
    assert (m.pct_strong_for_75, m.pct_strong_for_100, m.pct_strong_for_120) == (20.0, 40.0, None)


def test_flat_curve_and_missing_gap(spark):
    rows = [(i, i % 5 < 3, i % 5 < 3, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, weak_correct boolean, strong_correct boolean, score double")
    m = metrics.evaluate(df).first()
    assert m.auc == pytest.approx(0.6) and m.apgr is None and m.pct_strong_for_90 == 0.0


def test_cut_offs_round_half_to_even(spark):
    df = spark.createDataFrame([(i, False, True, -float(i)) for i in range(10)], "id long, weak_correct boolean, strong_correct boolean, score double")
    ks = {r.pct: r.k for r in metrics.accuracy_curve(df).collect()}
    assert ks == {p: round(p / 100 * 10) for p in range(0, 101, 5)} and ks[25] == 2 and ks[35] == round(3.5)


def test_operating_point_falls_back(spark):
    df = spark.createDataFrame([("a", 46.5), ("b", None)], "router string, pct_strong_for_90 double")
    assert [metrics.operating_point(df, r).first().pct for r in "ab"] == [46.5, 50.0]


@pytest.fixture(scope="module")
def decided(spark):
    rows = [(7, 0.2, False, True), (8, 0.9, False, True), (9, 0.8, True, False), (10, 0.7, True, False), (11, 0.1, True, False), (12, 0.3, False, True)]
    df = spark.createDataFrame(rows, "id long, score double, weak_correct boolean, need_strong boolean")
    return decisions.mark_decisions(df, 50.0)


def test_decisions_of_the_top_half(decided):
    flags = {r.id: (r.sent_to_strong, r.missed, r.wasted) for r in decided.collect()}
    sent = {8: (True, False, False), 9: (True, False, True), 10: (True, False, True)}
    assert flags == sent | {7: (False, True, False), 11: (False, False, False), 12: (False, True, False)}
    assert tuple(decisions.decision_totals(decided).first()) == (6, 2, 3, 2, 3)


def test_worst_examples(decided):
    """The missed ones from the lowest score on, the wasted ones from the highest."""
    got = [(r.error, r.id) for r in decisions.worst_examples(decided, 4).collect()]
    assert got == [("missed", 7), ("missed", 12), ("wasted", 9), ("wasted", 10)]


def test_worst_examples_share(spark):
    rows = [(i, i / 40, i % 2 == 0, i % 2 == 1) for i in range(40)]
    df = decisions.mark_decisions(spark.createDataFrame(rows, "id long, score double, weak_correct boolean, need_strong boolean"), 50.0)
    got = [(r.error, r.id) for r in decisions.worst_examples(df, 5).collect()]
    assert got == [("missed", 1), ("missed", 3), ("missed", 5), ("wasted", 38), ("wasted", 36)]


def test_small_subjects_are_listed_without_auroc(spark):
    rows = [(i, "big" if i < 30 else "small", i % 7 / 7, i % 3 == 0, i % 3 == 1) for i in range(35)]
    df = spark.createDataFrame(rows, "id long, subject string, score double, weak_correct boolean, need_strong boolean")
    table = decisions.subject_failures(decisions.mark_decisions(df, 40.0)).collect()
    assert [(r.subject, r.auroc is None) for r in table] == [("big", False), ("small", True)]
    assert not any(isinstance(r.auroc, float) and math.isnan(r.auroc) for r in table)
