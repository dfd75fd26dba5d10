"""Routing order, curves, areas, calls-to-target, AUROC, quantiles, bootstrap."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from tollgate.functions.outcomes import half_even
from tollgate.operators import bootstrap, metrics, ordered

# Few rows per bucket, so that the small tables are split the way huge ones are.
SMALL = 700


def gains_sql(rows: str, by: str = "", order: str = "score DESC, id") -> str:
    """CTE ``gains``: rank, running gain and the group's sums, by a plain window."""
    part = f"PARTITION BY {by}" if by else ""
    along = f"OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""
gains AS (SELECT *, count(*) {along} AS rank, sum(strong_correct::INT - weak_correct::INT) {along} AS gain,
                 count(*) OVER ({part}) AS n, sum(weak_correct::INT) OVER ({part}) AS n_weak,
                 sum(strong_correct::INT) OVER ({part}) AS n_strong FROM {rows})
"""


def curve_sql(by: str = "") -> str:
    """CTEs ``curve`` and ``metric`` from ``gains``; ``by`` may be empty. Areas are summed as
    whole numbers, so that values on the edge of a rounding step stay exact."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    same = " AND ".join(f"g.{c.strip()} = t.{c.strip()}" for c in by.split(",")) if by else "true"
    on_key = f"USING ({by})" if by else "ON true"
    goal = "({t} * (n_strong / n) - 1e-12)"
    return f"""
sizes AS (SELECT {keys}max(n) AS n, max(n_weak) AS n_weak, max(n_strong) AS n_strong FROM gains {group}),
curve AS (SELECT {', '.join(f't.{c.strip()}' for c in by.split(',')) + ', ' if by else ''}pct, k, (n_weak + coalesce(gain, 0)) / n AS accuracy, n_weak + coalesce(gain, 0) AS correct, n, n_weak, n_strong
          FROM (SELECT *, round_even(pct / 100::DOUBLE * n, 0)::BIGINT AS k FROM sizes, (SELECT unnest(range(0, 101, 5)) AS pct)) t
          LEFT JOIN (SELECT {keys}rank, gain FROM gains) g ON {same} AND g.rank = t.k),
areas AS (SELECT {keys}sum(area) AS area FROM (SELECT {keys}(pct - lag(pct) OVER w) * (correct + lag(correct) OVER w) AS area
          FROM curve WINDOW w AS ({f'PARTITION BY {by} ' if by else ''}ORDER BY pct)) {group}),
reach AS (SELECT {keys}min(100 * rank / n) FILTER ((n_weak + gain) / n >= {goal.format(t=0.9)}) AS r90,
                 min(100 * rank / n) FILTER ((n_weak + gain) / n >= {goal.format(t=0.95)}) AS r95 FROM gains {group}),
metric AS (SELECT {keys}n AS n_test, n_weak / n AS weak_acc, n_strong / n AS strong_acc, round_even(area / (200 * n), 6) AS auc,
                  CASE WHEN n_strong > n_weak THEN round_even((area - 200 * n_weak) / (200 * (n_strong - n_weak)), 6) END AS apgr,
                  CASE WHEN n_weak / n >= {goal.format(t=0.9)} THEN 0 ELSE round_even(r90, 6) END AS pct_strong_for_90,
                  CASE WHEN n_weak / n >= {goal.format(t=0.95)} THEN 0 ELSE round_even(r95, 6) END AS pct_strong_for_95
           FROM sizes JOIN areas {on_key} JOIN reach {on_key})
"""


def round6(df, *columns):
    return df.withColumns({c: F.bround(c, 6) for c in columns})


METRICS = ("auc", "apgr", "pct_strong_for_90", "pct_strong_for_95")

# The length of the prompt as a score: the labelled table's simplest router.
BY_LENGTH = f"{v.LABELLED}, by_length AS (SELECT *, length(prompt)::DOUBLE AS score FROM labelled)"


def by_length(spark, sf):
    return v.labelled(spark, sf, "CAST(length(text) AS DOUBLE)")


@check("evaluate_by_length", f"WITH {BY_LENGTH}, {gains_sql('by_length')}, {curve_sql()} SELECT * FROM metric")
def evaluate_by_length(spark, sf):
    return round6(metrics.evaluate(by_length(spark, sf)), *METRICS)


@check("evaluate_orders", f"WITH {v.orders_sql()}, {gains_sql('scored')}, {curve_sql()} SELECT * FROM metric")
def evaluate_orders(spark, sf):
    return round6(metrics.evaluate(v.orders_scored(spark, sf)), *METRICS)


@check("evaluate_by_subject", f"WITH {v.orders_sql()}, {gains_sql('scored', 'subject')}, {curve_sql('subject')} SELECT * FROM metric")
def evaluate_by_subject(spark, sf):
    return round6(metrics.evaluate(v.orders_scored(spark, sf), ["subject"]), *METRICS)


@check("evaluate_ties_split", f"WITH {v.orders_sql(True)}, {gains_sql('scored')}, {curve_sql()} SELECT * FROM metric")
def evaluate_ties_split(spark, sf):
    return round6(metrics.evaluate(v.orders_scored(spark, sf, True), rows_per_bucket=SMALL), *METRICS)


@check("accuracy_curve", f"WITH {v.orders_sql()}, {gains_sql('scored')}, {curve_sql()} SELECT pct::INT AS pct, k, round_even(accuracy, 6) AS accuracy FROM curve")
def accuracy_curve(spark, sf):
    return round6(metrics.accuracy_curve(v.orders_scored(spark, sf)), "accuracy")


@check(
    "accuracy_curve_by_subject",
    f"WITH {v.orders_sql(True)}, {gains_sql('scored', 'subject')}, {curve_sql('subject')} SELECT subject, pct::INT AS pct, k, round_even(accuracy, 6) AS accuracy FROM curve",
)
def accuracy_curve_by_subject(spark, sf):
    rows = v.orders_scored(spark, sf, True)
    return round6(metrics.accuracy_curve(rows, ["subject"], rows_per_bucket=100), "accuracy")


@check("curve_auc", f"WITH {BY_LENGTH}, {gains_sql('by_length')}, {curve_sql()} SELECT n_test, auc FROM metric")
def curve_auc(spark, sf):
    return round6(metrics.evaluate(by_length(spark, sf)), "auc").select("n_test", "auc")


@check("apgr_by_subject", f"WITH {v.orders_sql(True)}, {gains_sql('scored', 'subject')}, {curve_sql('subject')} SELECT subject, apgr FROM metric")
def apgr_by_subject(spark, sf):
    return round6(metrics.evaluate(v.orders_scored(spark, sf, True), ["subject"]), "apgr").select("subject", "apgr")


@check("pct_to_reach", f"WITH {v.orders_sql(True)}, {gains_sql('scored', 'subject')}, {curve_sql('subject')} SELECT subject, pct_strong_for_90, pct_strong_for_95 FROM metric")
def pct_to_reach(spark, sf):
    return round6(metrics.pct_to_reach(v.orders_scored(spark, sf, True), ["subject"]), "pct_strong_for_90", "pct_strong_for_95")


@check("ranked", f"WITH {v.orders_sql()}, {gains_sql('scored', 'subject')} SELECT id, rank FROM gains")
def ranked(spark, sf):
    return ordered.ranked(v.orders_scored(spark, sf), ["subject"]).select("id", "rank")


@check("ranked_split", f"WITH {v.orders_sql(True)}, {gains_sql('scored')} SELECT id, rank FROM gains")
def ranked_split(spark, sf):
    return ordered.ranked(v.orders_scored(spark, sf, True), [], rows_per_bucket=SMALL).select("id", "rank")


@check("cum_gain", f"WITH {v.orders_sql()}, {gains_sql('scored')} SELECT id, rank, gain::BIGINT AS gain, n FROM gains")
def cum_gain(spark, sf):
    return metrics.cum_gain(v.orders_scored(spark, sf), rows_per_bucket=SMALL).select("id", "rank", "gain", "n")


@check("half_even", "SELECT o_orderkey AS id, round_even(o_orderkey / 2::DOUBLE, 0) AS half FROM orders")
def halves(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), half_even(F.col("o_orderkey") / 2.0, 0).alias("half"))


def auroc_sql(rows: str, by: str = "") -> str:
    """Every positive against every negative, in the shape of mean ranks. CTE ``areas_roc``."""
    part, keys = (f"PARTITION BY {by} " if by else ""), (f"{by}, " if by else "")
    return f"""
mean_ranks AS (SELECT {keys}need_strong, avg(pos) OVER ({part + ',' if by else 'PARTITION BY '} score) AS r
               FROM (SELECT *, row_number() OVER ({part}ORDER BY score) AS pos FROM {rows})),
areas_roc AS (SELECT {keys}count(*) AS n, count(*) FILTER (need_strong) AS positives,
    CASE WHEN count(*) FILTER (need_strong) BETWEEN 1 AND count(*) - 1 THEN
      round_even((sum(r) FILTER (need_strong) - count(*) FILTER (need_strong) * (count(*) FILTER (need_strong) + 1) / 2)
                 / (count(*) FILTER (need_strong) * count(*) FILTER (NOT need_strong)), 6) END AS auroc
  FROM mean_ranks {f'GROUP BY {by}' if by else ''})
"""


@check("auroc", f"WITH {v.orders_sql()}, {auroc_sql('scored')} SELECT * FROM areas_roc")
def auroc(spark, sf):
    return round6(ordered.auroc(v.orders_scored(spark, sf), rows_per_bucket=SMALL), "auroc")


@check("auroc_by_subject", f"WITH {v.orders_sql(True)}, {auroc_sql('scored', 'subject')} SELECT * FROM areas_roc")
def auroc_by_subject(spark, sf):
    return round6(ordered.auroc(v.orders_scored(spark, sf, True), ["subject"]), "auroc")


@check(
    "exact_quantiles",
    f"""
WITH {v.orders_sql()} SELECT subject, round_even(quantile_cont(score, 0.5), 6) AS middle, round_even(quantile_cont(score, 0.9), 6) AS high
FROM scored GROUP BY subject
""",
)
def exact_quantiles(spark, sf):
    rows = ordered.exact_quantiles(v.orders_scored(spark, sf), ["subject"], "score", {"middle": 0.5, "high": 0.9}, 100)
    return round6(rows, "middle", "high")


@check(
    "operating_point",
    f"""
WITH {v.orders_sql()}, {gains_sql('scored', 'subject')}, {curve_sql('subject')}
SELECT subject AS router, coalesce(pct_strong_for_90, 50) AS pct FROM metric WHERE subject = 'NATION_3'
""",
)
def operating_point(spark, sf):
    rows = metrics.evaluate(v.orders_scored(spark, sf), ["subject"]).withColumnRenamed("subject", "router")
    return round6(metrics.operating_point(rows, "NATION_3"), "pct").select("router", "pct")


# --- bootstrap ---------------------------------------------------------------------------

REPLICATES = 1000
M64 = "18446744073709551615::UHUGEINT"


def drawn_sql(rows: str, replicates: int = REPLICATES) -> str:
    """n draws with replacement per replicate, each replicate evaluated draw by draw."""
    u = v.draw("replicate, ':', draw")
    return f"""
{gains_sql(rows)},
draws AS (SELECT replicate, floor({u} * n)::BIGINT + 1 AS rank
          FROM (SELECT unnest(range(0, {replicates})) AS replicate), (SELECT n, unnest(range(1, n + 1)) AS draw FROM (SELECT max(n) AS n FROM gains))),
resampled AS (SELECT replicate, weak_correct, strong_correct, n, sum(strong_correct::INT - weak_correct::INT) OVER w AS gain, row_number() OVER w AS place
              FROM draws JOIN gains USING (rank) WINDOW w AS (PARTITION BY replicate ORDER BY rank ROWS UNBOUNDED PRECEDING)),
replicate_sums AS (SELECT replicate, max(n) AS n, sum(weak_correct::INT) AS nw, sum(strong_correct::INT) AS ns FROM resampled GROUP BY replicate),
replicate_curve AS (SELECT s.replicate, pct, n, nw, ns, nw + coalesce(gain, 0) AS correct
    FROM (SELECT *, round_even(pct / 100::DOUBLE * n, 0)::BIGINT AS k FROM replicate_sums, (SELECT unnest(range(0, 101, 5)) AS pct)) s
    LEFT JOIN (SELECT replicate, place, gain FROM resampled) r ON r.replicate = s.replicate AND r.place = s.k),
replicate_areas AS (SELECT replicate, n, nw, ns, sum(area) AS area FROM (
    SELECT replicate, n, nw, ns, (pct - lag(pct) OVER w) * (correct + lag(correct) OVER w) AS area
    FROM replicate_curve WINDOW w AS (PARTITION BY replicate ORDER BY pct)) GROUP BY ALL),
replicate_apgr AS (SELECT replicate, CASE WHEN ns > nw THEN (area - 200 * nw) / (200 * (ns - nw)) END AS apgr FROM replicate_areas)
"""


def poisson_sql(rows: str, by: str = "", tie: str = "id", replicates: int = REPLICATES, seed: int = 42) -> str:
    """Each row counts Poisson(1) times in each replicate, drawn from its key. CTE ``replicate_apgr``; needs ``gains``."""
    keys = f"{by}, " if by else ""
    text = "concat_ws(':', '" + str(seed) + "', " + ", ".join(f"coalesce({c.strip()}::VARCHAR, '')" for c in tie.split(",")) + ")"
    stages = [
        f"row_keys AS (SELECT {keys}rank, weak_correct::INT AS w, strong_correct::INT AS s, ('0x' || substr(md5({text}), 1, 15))::UBIGINT AS key FROM {rows})",
        f"salts0 AS (SELECT r::INT AS replicate, ((r + 1)::UHUGEINT * 11400714819323198485::UHUGEINT + {seed}) & {M64} AS salt FROM range({replicates}) t(r))",
    ]
    for name, source, first, rest in (("salts", "salts0", "salt::UBIGINT", "replicate"), ("mixed", "crossed", "x", "* EXCLUDE (x)")):
        if name == "mixed":
            stages.append("crossed AS (SELECT k.*, replicate, xor(key, salt) AS x FROM row_keys k, salts)")
        stages.append(f"{name}_a AS (SELECT {rest}, xor({first}, {first} >> 30) AS x FROM {source})")
        stages.append(f"{name}_b AS (SELECT {rest}, ((x::UHUGEINT * 13787848793156543929::UHUGEINT) & {M64})::UBIGINT AS x FROM {name}_a)")
        stages.append(f"{name}_c AS (SELECT {rest}, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) & {M64})::UBIGINT AS x FROM {name}_b)")
        stages.append(f"{name} AS (SELECT {rest}, xor(x, x >> 31) AS {'salt' if name == 'salts' else 'x'} FROM {name}_c)")
    steps = " + ".join(f"(x >> 11 >= {int(step)})::INT" for step in bootstrap.poisson_steps())
    group = f"{keys}replicate"
    on = " AND ".join(f"r.{c.strip()} = s.{c.strip()}" for c in group.split(","))
    stages.append(f"weights AS (SELECT {group}, rank, w, s, {steps} AS m FROM mixed)")
    stages.append(f"upto AS (SELECT {group}, m, s - w AS step, sum(m) OVER o AS upto, sum(m * (s - w)) OVER o AS gained FROM weights WHERE m > 0 WINDOW o AS (PARTITION BY {group} ORDER BY rank ROWS UNBOUNDED PRECEDING))")
    stages.append(f"replicate_sums AS (SELECT {group}, sum(m) AS n, sum(m * w) AS nw, sum(m * s) AS ns FROM weights GROUP BY {group})")
    stages.append("replicate_cuts AS (SELECT *, round_even(pct / 100::DOUBLE * n, 0)::BIGINT AS k FROM replicate_sums, (SELECT unnest(range(0, 101, 5)) AS pct))")
    stages.append(
        f"replicate_curve AS (SELECT s.*, nw + coalesce(gained - (upto - k) * step, 0) AS correct FROM replicate_cuts s LEFT JOIN upto r ON {on} AND upto - m < k AND k <= upto)"
    )
    stages.append(f"replicate_areas AS (SELECT {group}, nw, ns, sum(area) AS area FROM (SELECT *, (pct - lag(pct) OVER o) * (correct + lag(correct) OVER o) AS area FROM replicate_curve WINDOW o AS (PARTITION BY {group} ORDER BY pct)) GROUP BY ALL)")
    stages.append(f"replicate_apgr AS (SELECT {group}, CASE WHEN ns > nw THEN (area - 200 * nw) / (200 * (ns - nw)) END AS apgr FROM replicate_areas)")
    return ",\n".join(stages)


def interval_sql(by: str = "") -> str:
    low, high = (f"round_even(quantile_cont(apgr, {q}), 6) AS apgr_ci_{n}" for q, n in ((0.025, "low"), (0.975, "high")))
    return f"SELECT {f'{by}, ' if by else ''}{low}, {high} FROM replicate_apgr {f'GROUP BY {by}' if by else ''}"


@check("bootstrap_replicates", f"WITH {BY_LENGTH}, {drawn_sql('by_length')} SELECT replicate::INT AS replicate, round_even(apgr, 6) AS apgr FROM replicate_apgr")
def bootstrap_replicates(spark, sf):
    return round6(bootstrap.replicate_apgr(by_length(spark, sf), replicates=REPLICATES, method="drawn"), "apgr")


@check("bootstrap_apgr", f"WITH {BY_LENGTH}, {drawn_sql('by_length')} {interval_sql()}")
def bootstrap_apgr(spark, sf):
    return round6(bootstrap.bootstrap_apgr(by_length(spark, sf), replicates=REPLICATES, method="drawn"), "apgr_ci_low", "apgr_ci_high")


@check("bootstrap_poisson", f"WITH {BY_LENGTH}, {gains_sql('by_length')}, {poisson_sql('gains')} SELECT replicate, round_even(apgr, 6) AS apgr FROM replicate_apgr")
def bootstrap_poisson(spark, sf):
    return round6(bootstrap.replicate_apgr(by_length(spark, sf), replicates=REPLICATES, rows_per_bucket=100), "apgr")


@check("bootstrap_apgr_large", f"WITH {v.orders_sql()}, {gains_sql('scored')}, {poisson_sql('gains')} {interval_sql()}")
def bootstrap_apgr_large(spark, sf):
    return round6(bootstrap.bootstrap_apgr(v.orders_scored(spark, sf), replicates=REPLICATES), "apgr_ci_low", "apgr_ci_high")
