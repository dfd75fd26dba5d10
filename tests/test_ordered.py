import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.operators import ordered


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    data = [(i, "hot" if rng.random() < 0.7 else f"g{i % 5}", rng.choice([0.0, 1.0, rng.random()]), rng.random() < 0.4) for i in range(4000)]
    return spark.createDataFrame(data, "id long, g string, score double, need_strong boolean")


def test_highest_first_and_ties_by_id(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 1.0), (3, None)], "id long, score double")
    ranks = {r.id: r["rank"] for r in ordered.ranked(df, []).collect()}
    assert ranks == {2: 1, 0: 2, 1: 3, 3: 4}


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("rows_per_bucket, parts", [(60, 1), (60, 7), (500, 64)])
def test_split_groups_give_the_same_ranks(scored, by, rows_per_bucket, parts):
    plain = sorted(ordered.ranked(scored, by).select("id", "rank").collect())
    moved = scored.orderBy(F.rand()).repartition(parts)
    assert sorted(ordered.ranked(moved, by, rows_per_bucket=rows_per_bucket).select("id", "rank").collect()) == plain


def test_buckets_are_even_under_heavy_ties(scored):
    keyed, group = ordered.with_sort_key(scored, [], [ordered.descending("score"), F.col("id")])
    bucketed, levels = ordered.with_buckets(keyed, group, 200)
    sizes = [r["count"] for r in bucketed.groupBy(*levels).count().collect()]
    assert len(levels) == 1 and len(sizes) == 20 and max(sizes) < 400


def test_buckets_keep_their_size_over_several_levels(scored):
    order = [ordered.descending("score"), F.col("id")]
    keyed, group = ordered.with_sort_key(scored, ["g"], order)
    bucketed, levels = ordered.with_buckets(keyed, group, 60, fan_out=4)
    sizes = [r["count"] for r in bucketed.groupBy(*group, *levels).count().collect()]
    assert len(levels) >= 3 and max(sizes) <= 120 and sum(sizes) == 4000
    totals = {"rank": F.lit(1), "positives": F.col("need_strong").cast("int")}
    run = lambda **o: sorted(ordered.running_totals(scored, ["g"], order, totals, ["rank"], **o).collect())
    assert run(rows_per_bucket=60, fan_out=4) == run()


def test_rows_with_equal_keys_end_the_levels(spark):
    df = spark.range(500).withColumn("score", F.lit(1.0))
    rows = ordered.running_totals(df, [], [F.col("score")], {"rank": F.lit(1)}, rows_per_bucket=20)
    assert sorted(r["rank"] for r in rows.collect()) == list(range(1, 501))


def test_a_split_reads_its_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 3000, 1, 4).mapInArrow(count, "id long").withColumn("score", F.col("id") % 7)
    ranks = ordered.ranked(rows, [], rows_per_bucket=100)
    assert ranks.count() == 3000 and ranks.agg(F.max("rank")).first()[0] == 3000
    assert seen.value == 6000  # once to count the groups, once to store it


def test_auroc_from_ranks_equals_auroc(spark, scored):
    odd = spark.createDataFrame([(9000, "g1", None, True), (9001, "g1", None, False), (9002, "g9", 0.5, True)], scored.schema)
    rows = scored.union(odd)
    plain = sorted(ordered.auroc(rows, ["g"]).collect(), key=str)
    ranks = ordered.ranked(rows, ["g"], rows_per_bucket=300)
    again = sorted(ordered.auroc_of_ranks(ranks, ["g"]).collect(), key=str)
    assert [(r.g, r.n, r.positives) for r in again] == [(r.g, r.n, r.positives) for r in plain]
    assert [r.auroc for r in again if r.g != "g9"] == pytest.approx([r.auroc for r in plain if r.g != "g9"])
    assert next(r for r in again if r.g == "g9").auroc is None


def test_auroc_counts_pairs(scored):
    rows = scored.collect()
    got = {r.g: r.auroc for r in ordered.auroc(scored, ["g"], rows_per_bucket=100).collect()}
    for g in got:
        pos = np.array([r.score for r in rows if r.g == g and r.need_strong])
        neg = np.array([r.score for r in rows if r.g == g and not r.need_strong])
        pairs = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
        assert got[g] == pytest.approx(pairs)


def test_auroc_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, True), (0.2, True)], "score double, need_strong boolean")
    assert ordered.auroc(df).first().auroc is None


@pytest.mark.parametrize("rows_per_bucket", [50, 10**6])
def test_quantiles_interpolate_like_numpy(scored, rows_per_bucket):
    qs = {"a": 0.0, "b": 0.123, "c": 0.5, "d": 0.975, "e": 1.0}
    row = ordered.exact_quantiles(scored, [], "score", qs, rows_per_bucket).first()
    values = [r.score for r in scored.collect()]
    for name, q in qs.items():
        assert row[name] == pytest.approx(np.quantile(values, q))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_task_and_no_python_in_the_ordered_pass(scored):
    from tollgate.operators import metrics

    rows = scored.withColumns({"weak_correct": F.col("id") % 2 == 0, "strong_correct": F.col("need_strong")})
    gains = metrics.cum_gain(rows, [], rows_per_bucket=300)
    plan = plan_of(gains)
    assert "SinglePartition" not in plan and "Python" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan_of(metrics.evaluate(rows, ["g"], rows_per_bucket=300))
