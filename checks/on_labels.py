"""Label and summaries of the routing table."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from tollgate.operators import labels


@check(
    "outcomes",
    f"""
WITH {v.LABELLED} SELECT id, need_strong, CASE WHEN weak_correct AND strong_correct THEN 'both_right' WHEN weak_correct THEN 'weak_only'
       WHEN strong_correct THEN 'need_strong' ELSE 'both_wrong' END AS outcome FROM labelled
""",
)
def outcomes(spark, sf):
    return labels.add_outcome(v.labelled(spark, sf)).select("id", "need_strong", "outcome")


@check(
    "label_summary",
    f"""
WITH {v.LABELLED} SELECT count(*) AS n, avg(weak_correct::INT) AS weak_acc, avg(strong_correct::INT) AS strong_acc,
       count(*) FILTER (need_strong) AS need_strong, avg(need_strong::INT) AS need_strong_rate,
       avg((weak_correct AND strong_correct)::INT) AS both_right, avg((NOT weak_correct AND NOT strong_correct)::INT) AS both_wrong,
       avg((weak_correct AND NOT strong_correct)::INT) AS weak_only, avg((weak_correct OR strong_correct)::INT) AS oracle_ceiling,
       avg(weak_correct::INT) > 0.9 AS weak_too_good, avg(strong_correct::INT) <= avg(weak_correct::INT) AS strong_no_better
FROM labelled
""",
)
def label_summary(spark, sf):
    return labels.label_summary(v.labelled(spark, sf))


@check(
    "chance_accuracy",
    f"WITH {v.QUESTIONS} SELECT round_even(avg(1.0::DOUBLE / len(options)), 6) AS chance_accuracy FROM questions",
)
def chance_accuracy(spark, sf):
    counted = v.questions(spark, sf).select(F.size("options").alias("n_options"))
    return labels.chance_accuracy(counted).withColumn("chance_accuracy", F.bround("chance_accuracy", 6))


COUNTED = f"{v.QUESTIONS}, {v.LABELLED}, counted AS (SELECT l.*, len(q.options)::BIGINT AS n_options FROM labelled l LEFT JOIN questions q USING (id))"


@check("option_counts", f"WITH {COUNTED} SELECT id, n_options FROM counted")
def option_counts(spark, sf):
    return labels.with_option_counts(v.labelled(spark, sf), v.questions(spark, sf)).select("id", "n_options")


@check(
    "chance_warning",
    f"""
WITH {COUNTED} SELECT count(*) AS n, avg(weak_correct::INT) AS weak_acc, round_even(avg(1.0::DOUBLE / n_options), 6) AS chance_accuracy,
       avg(weak_correct::INT) - avg(1.0::DOUBLE / n_options) < 0.05 AS near_chance FROM counted
""",
)
def chance_warning(spark, sf):
    counted = labels.with_option_counts(v.labelled(spark, sf), v.questions(spark, sf))
    return labels.chance_warning(counted).withColumn("chance_accuracy", F.bround("chance_accuracy", 6))


SUBJECT_STATS = """
SELECT subject, count(*) AS n, avg(weak_correct::INT) AS weak_acc, avg(strong_correct::INT) AS strong_acc,
       avg(need_strong::INT) AS need_strong_rate FROM {} GROUP BY subject
"""


@check("subject_stats", f"WITH {v.LABELLED} {SUBJECT_STATS.format('labelled')}")
def subject_stats(spark, sf):
    return labels.subject_stats(v.labelled(spark, sf))


@check(
    "subject_stats_top",
    f"WITH {v.orders_sql()} {SUBJECT_STATS.format('scored')} ORDER BY need_strong_rate DESC, subject LIMIT 10",
)
def subject_stats_top(spark, sf):
    return labels.subject_stats(v.orders_scored(spark, sf)).limit(10)
