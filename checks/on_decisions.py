"""Decisions at an operating point and what goes wrong."""

from pyspark.sql import functions as F

from checks import views as v
from checks.on_metrics import BY_LENGTH, auroc_sql, by_length, round6
from checks.registry import check
from tollgate.functions.draws import uniform
from tollgate.operators import decisions, quality

DECIDED = """
decided AS (SELECT *, NOT sent_to_strong AND need_strong AS missed, sent_to_strong AND weak_correct AS wasted FROM (
    SELECT *, row_number() OVER (ORDER BY score DESC, id) <= round_even(46.05::DOUBLE / 100 * count(*) OVER (), 0) AS sent_to_strong FROM {rows}))
"""
PCT = 46.05
ORDERS = f"{v.orders_sql()}, {DECIDED.format(rows='scored')}"
TEXTS = f"{v.PROMPTS}, {BY_LENGTH}, {DECIDED.format(rows='by_length')}"


def _orders(spark, sf):
    return decisions.mark_decisions(v.orders_scored(spark, sf), PCT, rows_per_bucket=3000)


def _texts(spark, sf):
    return decisions.mark_decisions(by_length(spark, sf), PCT)


def _features(spark, sf):
    return quality.question_features(quality.with_prompts(v.questions(spark, sf)))


@check("mark_decisions", f"WITH {ORDERS} SELECT id, sent_to_strong, missed, wasted FROM decided")
def mark_decisions(spark, sf):
    return _orders(spark, sf).select("id", "sent_to_strong", "missed", "wasted")


@check(
    "decision_totals",
    f"""
WITH {ORDERS} SELECT count(*) AS n, count(*) FILTER (missed) AS missed, count(*) FILTER (need_strong) AS need_strong,
       count(*) FILTER (wasted) AS wasted, count(*) FILTER (sent_to_strong) AS strong_calls FROM decided
""",
)
def decision_totals(spark, sf):
    return decisions.decision_totals(_orders(spark, sf))


EXAMPLES = """
examples AS (
  (SELECT *, 'missed' AS error FROM decided WHERE missed ORDER BY score, id LIMIT 8)
  UNION ALL
  (SELECT *, 'wasted' AS error FROM decided WHERE wasted ORDER BY score DESC, id
   LIMIT (SELECT 15 - least(8, count(*)) FROM decided WHERE missed)))
"""


@check("worst_examples", f"WITH {ORDERS}, {EXAMPLES} SELECT error, id, score FROM examples")
def worst_examples(spark, sf):
    return decisions.worst_examples(_orders(spark, sf)).select("error", "id", "score")


FEATURED = "SELECT {what}, len(p.options)::BIGINT AS n_options, CASE WHEN p.id IS NOT NULL THEN p.context IS NOT NULL END AS has_context, length(p.prompt)::BIGINT AS prompt_chars"


@check(
    "failure_examples",
    f"""
WITH {TEXTS}, {EXAMPLES} {FEATURED.format(what='e.error, e.id, e.subject, e.score, e.weak_correct, e.strong_correct')}, p.question
FROM examples e LEFT JOIN prompts p USING (id)
""",
)
def failure_examples(spark, sf):
    columns = (*decisions.FEATURES, "question")
    rows = decisions.with_features(decisions.worst_examples(_texts(spark, sf)), _features(spark, sf), columns)
    return rows.select("error", "id", "subject", "score", "weak_correct", "strong_correct", *columns)


@check(
    "error_patterns",
    f"""
WITH {TEXTS}, {EXAMPLES}, rows_seen AS (SELECT error, id FROM examples UNION ALL SELECT 'all', id FROM decided)
SELECT error, round_even(avg(len(options)), 6) AS n_options,
       round_even(avg(CASE WHEN p.id IS NOT NULL THEN (p.context IS NOT NULL)::INT END), 6) AS has_context,
       round_even(avg(length(prompt)), 6) AS prompt_chars
FROM rows_seen r LEFT JOIN prompts p USING (id) GROUP BY error
""",
)
def error_patterns(spark, sf):
    decided, features = _texts(spark, sf), _features(spark, sf)
    examples = decisions.with_features(decisions.worst_examples(decided), features)
    rows = decisions.error_patterns(examples, decisions.with_features(decided, features))
    return round6(rows, *decisions.FEATURES)


SUBJECTS = f"""
{auroc_sql('decided', 'subject')},
subjects AS (SELECT subject, d.n, need_strong, CASE WHEN d.n >= 20 AND need_strong >= 3 AND need_strong < d.n THEN auroc END AS auroc,
                    missed_rate, wasted_rate
             FROM (SELECT subject, count(*) AS n, count(*) FILTER (need_strong) AS need_strong, avg(missed::INT) AS missed_rate,
                          avg(wasted::INT) AS wasted_rate FROM decided GROUP BY subject) d JOIN areas_roc USING (subject))
"""


@check("subject_failures", f"WITH {ORDERS}, {SUBJECTS} SELECT * FROM subjects")
def subject_failures(spark, sf):
    return round6(decisions.subject_failures(_orders(spark, sf)), "auroc")


@check("subject_failures_small_groups", f"WITH {TEXTS}, {SUBJECTS} SELECT * FROM subjects")
def subject_failures_small_groups(spark, sf):
    return round6(decisions.subject_failures(_texts(spark, sf)), "auroc")


@check("hardest_subjects", f"WITH {ORDERS}, {SUBJECTS} SELECT subject, auroc FROM subjects WHERE auroc IS NOT NULL ORDER BY auroc, subject LIMIT 5")
def hardest_subjects(spark, sf):
    return round6(decisions.hardest(decisions.subject_failures(_orders(spark, sf))), "auroc").select("subject", "auroc")


@check("easiest_subjects", f"WITH {ORDERS}, {SUBJECTS} SELECT subject, auroc FROM subjects WHERE auroc IS NOT NULL ORDER BY auroc DESC, subject DESC LIMIT 5")
def easiest_subjects(spark, sf):
    return round6(decisions.easiest(decisions.subject_failures(_orders(spark, sf))), "auroc").select("subject", "auroc")


@check("threshold", f"WITH {v.orders_sql()} SELECT round_even(quantile_cont(score, 1 - 46.05::DOUBLE / 100), 6) AS threshold FROM scored")
def threshold(spark, sf):
    return round6(decisions.threshold(v.orders_scored(spark, sf), PCT, rows_per_bucket=2000), "threshold")


ROUTE = f"WITH {v.SPLIT_TEXTS} SELECT id, CASE WHEN {v.draw('id')} >= 0.4::DOUBLE THEN 'strong' ELSE 'weak' END AS role FROM split_texts WHERE len(options) >= 2"


@check("route", ROUTE)
def route(spark, sf):
    ready = decisions.routable(quality.split_questions(v.free_texts(spark, sf)))
    return decisions.route(ready.withColumn("score", uniform(F.col("id"), 42)), 0.4).select("id", "role")


# Plain documents as texts: most carry no options and are turned away.
DOC_TEXTS = v.SPLIT_TEXTS.replace("FROM free_texts)", "FROM (SELECT doc_id AS id, text FROM documents))")


@check("route_rejected", f"WITH {DOC_TEXTS} SELECT id, len(options)::BIGINT AS n_options FROM split_texts WHERE len(options) < 2")
def route_rejected(spark, sf):
    texts = v.table(spark, sf, "documents").selectExpr("doc_id AS id", "text")
    rows = decisions.rejected(quality.split_questions(texts))
    return rows.select("id", F.size("options").cast("bigint").alias("n_options"))
