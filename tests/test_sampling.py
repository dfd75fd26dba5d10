import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tollgate.functions.draws import uniform
from tollgate.operators import sampling


def quotas(spark, sizes, n, **options):
    df = spark.createDataFrame(list(sizes.items()), "g string, size long")
    return {r.g: r.quota for r in sampling.allocate(df, ["g"], n, **options).collect()}


@pytest.mark.parametrize(
    "sizes, n, expected",
    [
        ({"p": 90, "q": 54, "r": 36}, 20, {"p": 10, "q": 6, "r": 4}),
        ({"p": 400, "q": 3, "r": 2, "s": 1}, 6, {"p": 3, "q": 1, "r": 1, "s": 1}),
        ({"p": 4, "q": 1, "r": 2}, 50, {"p": 4, "q": 1, "r": 2}),
        ({"a": 3, "b": 2, "c": 1}, 2, {"a": 1, "b": 1, "c": 0}),
    ],
)
def test_quota_examples(spark, sizes, n, expected):
    assert quotas(spark, sizes, n) == expected


def by_steps(sizes, n):
    """The rule one row at a time."""
    n = min(n, sum(sizes.values()))
    order = sorted(sizes, key=lambda g: (-sizes[g], g))
    share = {g: sizes[g] / sum(sizes.values()) * n for g in order}
    got = {g: min(sizes[g], max(int(share[g]), 1 if n >= len(sizes) else 0)) for g in order}
    turn = sorted(order, key=lambda g: (-(share[g] - got[g]), -sizes[g], g))
    for g in turn[: max(0, n - sum(got.values()))]:
        got[g] += 1
    while sum(got.values()) > n:
        got[max(order, key=lambda g: got[g])] -= 1
    return got


def test_quotas_equal_the_rule_step_by_step(spark):
    rng = random.Random(1)
    for _ in range(12):
        sizes = {f"g{i:02d}": rng.choice([1, 2, 3, 9, 40, 500]) for i in range(rng.randint(2, 40))}
        n = rng.choice([1, 5, len(sizes), len(sizes) + 3, 4 * len(sizes)])
        assert quotas(spark, sizes, n) == by_steps(sizes, n)


def rows(spark, n=200, subjects=10):
    rng = random.Random(0)
    data = [(i, f"s{i % subjects}", rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(data, "id long, subject string, need_strong boolean")


def test_sample_has_its_quotas_and_ignores_layout(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 12 // 5]) for i in range(144)], "id long, subject string")
    first = sampling.stratified_sample(df, "subject", 24, seed=1).orderBy("sample_rank").collect()
    again = sampling.stratified_sample(
        df.orderBy(F.rand()).repartition(7), "subject", 24, seed=1, rows_per_slot=3, rows_per_bucket=2
    ).orderBy("sample_rank").collect()
    assert first == again and Counter(r.subject for r in first) == {"x": 10, "y": 10, "z": 4}
    assert [r.sample_rank for r in first] == list(range(1, 25))
    other = sampling.stratified_sample(df, "subject", 24, seed=2).collect()
    assert {r.id for r in other} != {r.id for r in first}


def test_lowest_draws_are_picked_in_a_skewed_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 100 == 0, "few").otherwise("many"))
    wanted = sampling.group_sizes(df, ["g"]).withColumn("quota", F.when(F.col("g") == "few", 50).otherwise(1234).cast("long"))
    draw = uniform(F.col("id"), 5)
    marked = sampling.mark_lowest(df, ["g"], wanted, draw, rows_per_slot=37).withColumn("u", draw).collect()
    for g, quota in (("few", 50), ("many", 1234)):
        group = sorted((r.u, r.id, r.picked) for r in marked if r.g == g)
        assert [p for *_, p in group] == [True] * quota + [False] * (len(group) - quota)


def test_random_split_sizes(spark):
    df = rows(spark)
    parts = sampling.random_split(df).collect()
    assert len(parts) == 200 and Counter(r.part for r in parts) == {"test": 60, "train": 140}
    share = sum(r.need_strong for r in parts) / 200
    tested = [r.need_strong for r in parts if r.part == "test"]
    assert abs(sum(tested) / 60 - share) < 0.02


def test_folds_keep_subjects_together(spark):
    df = rows(spark)
    folds = sampling.group_folds(df).collect()
    assert sorted(r.id for r in folds) == list(range(200))
    assert len({r.fold for r in folds}) == 5
    assert all(len({r.fold for r in folds if r.subject == s}) == 1 for s in {r.subject for r in folds})


def lightest_first(sizes, k):
    load, place = [0] * k, {}
    for g, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        f = load.index(min(load))
        place[g], load[f] = f, load[f] + n
    return place, load


def test_folds_equal_the_greedy_rule(spark):
    rng = random.Random(3)
    sizes = [(f"g{i:03d}", rng.choice([1, 2, 7, 30, 400])) for i in range(120)]
    got = sampling.fold_of_groups(spark.createDataFrame(sizes, "g string, size long"), "g", 5).collect()
    assert {r.g: r.fold for r in got} == lightest_first(sizes, 5)[0]


@pytest.mark.parametrize("k", [2, 5, 7])
def test_many_groups_follow_the_same_rule(spark, k):
    rng = random.Random(4)
    sizes = [(f"g{i:04d}", 2000 if i == 0 else rng.randint(1, 9)) for i in range(3000)] + [("h", 777), ("empty", 0)]
    got = sampling.fold_of_groups(spark.createDataFrame(sizes, "g string, size long"), "g", k, rows_per_bucket=100).collect()
    assert {r.g: r.fold for r in got} == lightest_first(sizes, k)[0]


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(i, None if i % 10 < 3 else f"s{i % 4}", None if i % 10 == 0 else i % 3 == 0) for i in range(100)], "id long, subject string, need_strong boolean")
    assert sampling.stratified_sample(df, "subject", 20).count() == 20
    folds = sampling.group_folds(df).collect()
    assert len(folds) == 100 and len({r.fold for r in folds if r.subject is None}) == 1
    parts = Counter(r.part for r in sampling.random_split(df).collect())
    assert parts == {"test": 30, "train": 70}


def test_split_table_has_no_leak(spark):
    df = rows(spark)
    splits = sampling.make_splits(df)
    balance = {(r.setup, r.fold, r.part): r.n for r in sampling.split_balance(df, splits).collect()}
    assert balance["random", 0, "test"] == 60 and balance["random", 0, "train"] == 140
    assert all(balance["unseen_subjects", f, "test"] + balance["unseen_subjects", f, "train"] == 200 for f in range(5))
