"""Routers: scores, features, out-of-sample scoring, training and batch routing."""

import dataclasses

import numpy as np
from pyspark.sql import functions as F

from checks import views as v
from checks.on_metrics import METRICS, auroc_sql, curve_sql, gains_sql, interval_sql, poisson_sql, round6
from checks.on_sampling import SPLITS
from checks.registry import check
from tollgate.defaults import MAX_FEATURES
from tollgate.operators import metrics
from tollgate.operators.ordered import auroc
from tollgate.operators.sampling import make_splits, plan_splits
from tollgate.plans import analyse, route
from tollgate.routers import EmbeddingRouter, HashedTfidfRouter, LengthRouter, OracleRouter, RandomRouter, TfidfRouter
from tollgate.routers.embedding import mean_pool, with_embeddings
from tollgate.routers.scoring import score_splits
from tollgate.routers.tfidf import damped_counts, gram_counts, text_grams, vocabulary, weighted_features
from tollgate.session import new_path, written
from tollgate.sources.bundle import load_bundle, save_router
from tollgate.sources.vectors import upsert_embeddings

LENGTH_SHARE = "(SELECT count(*) FROM labelled t WHERE length(t.prompt) <= length(r.prompt)) / (SELECT count(*) FROM labelled)"


@check("random_router", f"WITH {v.LABELLED} SELECT id, {v.draw('id')} AS score FROM labelled")
def random_router(spark, sf):
    table = v.labelled(spark, sf)
    return RandomRouter().fit(table).score(table).select("id", "score")


@check("length_router", f"WITH {v.LABELLED} SELECT id, {LENGTH_SHARE} AS score FROM labelled r")
def length_router(spark, sf):
    table = v.labelled(spark, sf)
    return LengthRouter().fit(table).score(table).select("id", "score")


@check("oracle_router", f"WITH {v.LABELLED} SELECT id, need_strong::INT::DOUBLE AS score FROM labelled")
def oracle_router(spark, sf):
    table = v.labelled(spark, sf)
    return OracleRouter().fit(table).score(table).select("id", "score")


GRAMS = f"""
{v.LABELLED},
padded AS (SELECT id, ' ' || w || ' ' AS w FROM (SELECT id, unnest(list_filter(string_split_regex(lower(prompt), '\\s+'), lambda x: x <> '')) AS w FROM labelled)),
sized AS (SELECT id, w, unnest(range(2, least(5, length(w)) + 1)) AS n FROM padded),
placed AS (SELECT id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM sized),
gram_list AS (SELECT id, substring(w, i::INT, n::INT) AS gram FROM placed),
gram_counts AS (SELECT gram, count(*) AS tf, count(DISTINCT id) AS df FROM gram_list GROUP BY gram)
"""


@check("char_grams", f"WITH {GRAMS} SELECT id, gram, count(*) AS n FROM gram_list GROUP BY id, gram")
def grams(spark, sf):
    return text_grams(v.labelled(spark, sf))


@check("gram_counts", f"WITH {GRAMS} SELECT * FROM gram_counts")
def counted_grams(spark, sf):
    return gram_counts(v.labelled(spark, sf))


@check(
    "tfidf_vocabulary",
    f"""
WITH {GRAMS} SELECT gram, tf, df, round_even(ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1, 6) AS idf
FROM gram_counts WHERE df >= 2 ORDER BY tf DESC, gram LIMIT {MAX_FEATURES}
""",
)
def tfidf_vocabulary(spark, sf):
    table = v.labelled(spark, sf)
    rows = vocabulary(written(gram_counts(table), "grams"), table.count())
    return rows.select("gram", "tf", "df", F.bround("idf", 6).alias("idf"))


# Terms whose number decides whether they are taken: a limit within the ties.
@check(
    "tfidf_vocabulary_ties",
    f"""
WITH {GRAMS} SELECT gram, tf, df, round_even(ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1, 6) AS idf
FROM gram_counts WHERE df >= 2 ORDER BY tf DESC, gram LIMIT 1234
""",
)
def tfidf_vocabulary_ties(spark, sf):
    table = v.labelled(spark, sf)
    rows = vocabulary(written(gram_counts(table), "grams"), table.count(), 1234, rows_per_bucket=300)
    return rows.select("gram", "tf", "df", F.bround("idf", 6).alias("idf"))


@check(
    "tfidf_weights",
    f"""
WITH {GRAMS}, vocab AS (SELECT gram, ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1 AS idf
                        FROM gram_counts WHERE df >= 2 ORDER BY tf DESC, gram LIMIT {MAX_FEATURES}),
weighed AS (SELECT id, (1 + ln(count(*))) * any_value(idf) AS w FROM gram_list JOIN vocab USING (gram) GROUP BY id, gram)
SELECT id, count(*) AS terms, round_even(sum(w) / sqrt(sum(w * w)), 6) AS total, round_even(max(w) / sqrt(sum(w * w)), 6) AS largest
FROM weighed GROUP BY id
""",
)
def tfidf_weights(spark, sf):
    table = v.labelled(spark, sf)
    idf = TfidfRouter().idf_of_terms(written(gram_counts(table), "grams"), table.count())
    rows = weighted_features(damped_counts(table, list(idf)), list(idf.values()))
    values = F.col("v.values")
    return rows.select("id", F.unwrap_udt("features").alias("v")).where(F.size("v.indices") > 0).select(
        "id",
        F.size("v.indices").cast("bigint").alias("terms"),
        F.bround(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.bround(F.array_max(values), 6).alias("largest"),
    )


@check("tfidf_router")
def tfidf_router(spark, sf):
    table = v.labelled(spark, sf)
    return TfidfRouter().fit(table).score(table).select("id", "score")


def letter_encoder():
    """Stands in for a sentence encoder: how often characters of each class modulo 64 occur."""

    def encode(texts):
        return np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype="<u4") % 64, minlength=64) for t in texts])

    return encode


def unit_encoder():
    """The same as vectors of unit length, as sentence encoders give."""
    encode = letter_encoder()

    def unit(texts):
        counts = encode(texts).astype(np.float64)
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1.0)

    return unit


def filled_store(spark, table):
    """A store with a vector for every row; the given one has only some ids, and vectors of another encoder cannot be mixed in."""
    return upsert_embeddings(new_path(spark, "vectors"), table, unit_encoder)


@check("tfidf_hashed_router")
def tfidf_hashed_router(spark, sf):
    table = v.labelled(spark, sf)
    return HashedTfidfRouter().fit(table).score(table).select("id", "score")


@check("embedding_router")
def embedding_router(spark, sf):
    table = v.labelled(spark, sf)
    return EmbeddingRouter(filled_store(spark, table)).fit(table).score(table).select("id", "score")


# Two features of the prompt as a vector, and the regression over them by full Newton steps, each solved by determinants.
FEATURED = f"""
{v.LABELLED}, featured AS (SELECT *, length(prompt) / 1000::DOUBLE AS x1, len(string_split(prompt, 'e')) / 100::DOUBLE AS x2 FROM labelled)
"""
NEWTON_STEPS = 12


def featured(spark, sf):
    cells = [F.length("prompt") / 1000.0, F.size(F.split("prompt", "e", -1)) / 100.0]
    return v.labelled(spark, sf).withColumn("embedding", F.array(*cells))


def newton_sql(train: str, by: str = "") -> str:
    """CTE ``fitted`` (by..., b1, b2, b0) from rows (by..., x1, x2, need_strong). Both classes weigh the same, the ridge
    is 1 for b1 and b2."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    stages = [
        f"class_n AS (SELECT {keys}count(*) AS n, count(*) FILTER (need_strong) AS p FROM {train} {group})",
        f"fit_rows AS MATERIALIZED (SELECT {keys}x1, x2, need_strong::INT AS y, CASE WHEN need_strong THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS cw FROM {train} {f'JOIN class_n USING ({by})' if by else ', class_n'})",
        f"step0 AS (SELECT {keys}0::DOUBLE AS b1, 0::DOUBLE AS b2, 0::DOUBLE AS b0 FROM class_n)",
    ]
    same = f"JOIN step{{i}} USING ({by})" if by else ", step{i}"
    for i in range(NEWTON_STEPS):
        stages.append(f"at{i} AS (SELECT {keys}x1, x2, y, cw, b1, b2, b0, 1 / (1 + exp(-(b1 * x1 + b2 * x2 + b0))) AS q FROM fit_rows {same.format(i=i)})")
        stages.append(
            f"sums{i} AS (SELECT {keys}any_value(b1) AS b1, any_value(b2) AS b2, any_value(b0) AS b0, sum(cw * (q - y) * x1) + any_value(b1) AS g1, sum(cw * (q - y) * x2) + any_value(b2) AS g2, "
            f"sum(cw * (q - y)) AS g0, sum(cw * q * (1 - q) * x1 * x1) + 1 AS h11, sum(cw * q * (1 - q) * x1 * x2) AS h12, sum(cw * q * (1 - q) * x2 * x2) + 1 AS h22, "
            f"sum(cw * q * (1 - q) * x1) AS h10, sum(cw * q * (1 - q) * x2) AS h20, sum(cw * q * (1 - q)) AS h00 FROM at{i} {group})"
        )
        det = lambda a, b, c, d, e, f, g, h, k: f"({a} * ({e} * {k} - {f} * {h}) - {b} * ({d} * {k} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
        whole = det("h11", "h12", "h10", "h12", "h22", "h20", "h10", "h20", "h00")
        d1 = det("g1", "h12", "h10", "g2", "h22", "h20", "g0", "h20", "h00")
        d2 = det("h11", "g1", "h10", "h12", "g2", "h20", "h10", "g0", "h00")
        d0 = det("h11", "h12", "g1", "h12", "h22", "g2", "h10", "h20", "g0")
        stages.append(f"step{i + 1} AS MATERIALIZED (SELECT {keys}b1 - {d1} / {whole} AS b1, b2 - {d2} / {whole} AS b2, b0 - {d0} / {whole} AS b0 FROM sums{i})")
    return ",\n".join([*stages, f"fitted AS (SELECT * FROM step{NEWTON_STEPS})"])


LOGISTIC = "round_even(1 / (1 + exp(-(b1 * x1 + b2 * x2 + b0))), 6) AS score"


@check("embedding_router_two_features", f"WITH {FEATURED}, {newton_sql('featured')} SELECT id, {LOGISTIC} FROM featured, fitted")
def embedding_router_two_features(spark, sf):
    table = featured(spark, sf)
    return EmbeddingRouter().fit(table).score(table).select("id", F.bround("score", 6).alias("score"))


@check(
    "with_embeddings",
    f"""
WITH {v.LABELLED}, letters AS (SELECT id, unicode(c) % 64 AS place, count(*) AS n FROM (SELECT id, unnest(string_split('query: ' || prompt, '')) AS c FROM labelled) GROUP BY ALL)
SELECT id, 64::BIGINT AS dimensions, round_even(sum(((n / sqrt(total))::FLOAT::DOUBLE) ** 2), 5) AS squares, round_even(max((n / sqrt(total))::FLOAT::DOUBLE), 5) AS largest,
       count(*) AS filled
FROM (SELECT *, sum(n * n) OVER (PARTITION BY id) AS total FROM letters) GROUP BY id
""",
)
def embeddings_of(spark, sf):
    """Every labelled row with its vector from a filled store."""
    table = v.labelled(spark, sf)
    rows = with_embeddings(table, filled_store(spark, table))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select(
        "id",
        F.size("embedding").cast("bigint").alias("dimensions"),
        F.bround(squares, 5).alias("squares"),
        F.bround(F.array_max("embedding").cast("double"), 5).alias("largest"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("filled"),
    )


@check(
    "mean_pool",
    """
WITH cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS position FROM embeddings),
means AS (SELECT label, position, avg(x) AS m FROM cells GROUP BY ALL)
SELECT label, position::BIGINT AS position, round_even(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM means
""",
)
def pooled(spark, sf):
    rows = mean_pool(v.vectors(spark, sf), "label").select("label", F.posexplode("embedding").alias("p", "x"))
    return rows.select("label", (F.col("p") + 1).cast("bigint").alias("position"), F.bround("x", 6).alias("value"))


# --- out-of-sample scoring -------------------------------------------------------------

PLACES = f"""
{SPLITS},
places AS (SELECT s.setup, s.fold, l.* FROM splits s JOIN labelled l USING (id) WHERE s.part = 'test'),
sides AS (SELECT s.setup, s.fold, length(prompt) AS length FROM splits s JOIN labelled USING (id) WHERE s.part = 'train'
          UNION ALL SELECT s.setup, f.fold, length(prompt) FROM splits s JOIN labelled USING (id)
          JOIN (SELECT DISTINCT fold FROM folds) f ON s.fold <> f.fold WHERE s.setup = 'unseen_subjects'),
shares AS (SELECT p.setup, p.fold, p.id, count(*) FILTER (t.length <= length(p.prompt)) / count(*) AS score
           FROM places p JOIN sides t ON t.setup = p.setup AND t.fold = p.fold GROUP BY p.setup, p.fold, p.id),
scores AS (SELECT p.* EXCLUDE (prompt), 'random' AS router, {v.draw('id')} AS score FROM places p
           UNION ALL SELECT p.* EXCLUDE (prompt), 'oracle', need_strong::INT::DOUBLE FROM places p
           UNION ALL SELECT p.* EXCLUDE (prompt), 'length', score FROM places p JOIN shares USING (setup, fold, id))
"""


for name in ("random", "length", "oracle"):
    check(f"score_splits_{name}", f"WITH RECURSIVE {v.LABELLED}, {PLACES} SELECT * FROM scores WHERE router = '{name}'")(
        lambda spark, sf, name=name: score_splits(v.labelled(spark, sf), plan_splits(v.labelled(spark, sf)), name)
    )


# The same with a stored table of splits, which is joined by id.
@check("score_splits_stored", f"WITH RECURSIVE {v.LABELLED}, {PLACES} SELECT * FROM scores WHERE router = 'length'")
def score_splits_stored(spark, sf):
    table = v.labelled(spark, sf)
    return score_splits(table, written(make_splits(table), "splits"), "length")


# One regression over two features for each training side.
@check(
    "score_splits_two_features",
    f"""
WITH RECURSIVE {FEATURED}, {PLACES}, train_sides AS (
  SELECT s.setup, s.fold, x1, x2, need_strong FROM splits s JOIN featured USING (id) WHERE s.part = 'train'
  UNION ALL SELECT s.setup, f.fold, x1, x2, need_strong FROM splits s JOIN featured USING (id) JOIN (SELECT DISTINCT fold FROM folds) f ON s.fold <> f.fold WHERE s.setup = 'unseen_subjects'),
{newton_sql('train_sides', 'setup, fold')}
SELECT s.setup, s.fold, e.id, {LOGISTIC} FROM splits s JOIN featured e USING (id) JOIN fitted USING (setup, fold) WHERE s.part = 'test'
""",
)
def score_splits_two_features(spark, sf):
    table = featured(spark, sf)
    scores = score_splits(table, plan_splits(table), "embedding")
    return scores.select("setup", "fold", "id", F.bround("score", 6).alias("score"))


@check("score_splits_tfidf")
def score_splits_tfidf(spark, sf):
    table = v.labelled(spark, sf)
    return score_splits(table, plan_splits(table), "tfidf")


@check("score_splits_embedding")
def score_splits_embedding(spark, sf):
    table = v.labelled(spark, sf)
    return score_splits(table, plan_splits(table), "embedding", store=filled_store(spark, table))


def _scores(spark, sf):
    table = v.labelled(spark, sf)
    return analyse.score_all(table, plan_splits(table), ["random", "length", "oracle"])


@check("evaluate_routers", f"WITH RECURSIVE {v.LABELLED}, {PLACES}, {gains_sql('scores', 'setup, router', 'score DESC, fold, id')}, {curve_sql('setup, router')} SELECT * FROM metric")
def evaluate_routers(spark, sf):
    return round6(metrics.evaluate(_scores(spark, sf), analyse.SETUPS, tie=analyse.TIE), *METRICS)


@check("router_auroc", f"WITH RECURSIVE {v.LABELLED}, {PLACES}, {auroc_sql('scores', 'setup, router')} SELECT * FROM areas_roc")
def router_auroc(spark, sf):
    return round6(auroc(_scores(spark, sf), analyse.SETUPS), "auroc")


@check(
    "report",
    f"""
WITH RECURSIVE {v.LABELLED}, {PLACES}, {gains_sql('scores', 'setup, router', 'score DESC, fold, id')}, {curve_sql('setup, router')}, {auroc_sql('scores', 'setup, router')},
{poisson_sql('gains', 'setup, router', 'fold, id')}, intervals AS ({interval_sql('setup, router')})
SELECT * FROM metric JOIN intervals USING (setup, router) JOIN (SELECT setup, router, auroc FROM areas_roc) USING (setup, router)
""",
)
def report(spark, sf):
    """All numbers of three routers from scores that were ordered once."""
    return round6(analyse.report(_scores(spark, sf)), *METRICS, "apgr_ci_low", "apgr_ci_high", "auroc")


@check("report_all_routers")
def report_all_routers(spark, sf):
    table = v.labelled(spark, sf)
    routers = ["random", "length", "tfidf", "embedding", "oracle"]
    scores = analyse.score_all(table, plan_splits(table), routers, embedding={"store": filled_store(spark, table)})
    return analyse.report(scores)


# --- the final router -------------------------------------------------------------------

TRAINED = f"""
{v.LABELLED}, shares AS (SELECT id, {LENGTH_SHARE} AS score FROM labelled r),
cutoff AS (SELECT quantile_cont(score, 1 - 40::DOUBLE / 100) AS threshold, count(*) AS n_train FROM shares)
"""


def length_bundle(spark, sf):
    """The length router trained on all rows, saved with its cut-off and loaded again."""
    path = new_path(spark, "router")
    save_router(route.train_router(v.labelled(spark, sf), LengthRouter(), 40.0), path)
    return load_bundle(spark, path)


@check("train_router", f"WITH {TRAINED} SELECT round_even(threshold, 6) AS threshold, 40::DOUBLE AS pct_strong, n_train FROM cutoff")
def train_router(spark, sf):
    b = length_bundle(spark, sf)
    fitted = b.router.score(v.labelled(spark, sf))
    return fitted.agg(
        F.bround(F.lit(b.threshold), 6).alias("threshold"), F.lit(b.pct_strong).alias("pct_strong"), F.count("*").alias("n_train")
    )


ROUTED = v.SPLIT_TEXTS + f""",
asked AS (SELECT id, options, concat(trim(question), chr(10), array_to_string(list_transform(options, lambda o, i:
          concat(substring('ABCDE', i::INT, 1), '. ', trim(o))), chr(10)), chr(10), 'Answer with one letter only.') AS prompt
          FROM split_texts WHERE len(options) >= 2)
"""


@check(
    "route_batch",
    f"""
WITH {ROUTED}, {TRAINED}, asked_scores AS (SELECT id, prompt, {LENGTH_SHARE} AS score FROM asked r)
SELECT id, prompt, score, CASE WHEN score >= (SELECT threshold FROM cutoff) THEN 'strong' ELSE 'weak' END AS role FROM asked_scores
""",
)
def route_batch(spark, sf):
    return route.route_batch(v.free_texts(spark, sf), length_bundle(spark, sf)).select("id", "prompt", "score", "role")


@check("route_batch_embedding")
def route_batch_embedding(spark, sf):
    """Every routable text gets a role, also one that no store knows."""
    path = new_path(spark, "router")
    save_router(route.train_router(v.labelled(spark, sf), EmbeddingRouter(make_encoder=letter_encoder), 46.0), path)
    bundle = load_bundle(spark, path)
    bundle = dataclasses.replace(bundle, router=bundle.router.with_encoder(letter_encoder))
    return route.route_batch(v.free_texts(spark, sf), bundle).select("id", "score", "role")
