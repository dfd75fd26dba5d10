import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tollgate.functions import grams
from tollgate.functions.text import char_grams
from tollgate.operators import sampling
from tollgate.operators.sums import summed
from tollgate.plans import route
from tollgate.routers import ROUTERS, EmbeddingRouter, LengthRouter, OracleRouter, RandomRouter, TfidfRouter, register_router
from tollgate.routers.baselines import FittedLengthRouter
from tollgate.routers.embedding import with_embeddings
from tollgate.routers import regression, tfidf
from tollgate.routers.regression import fit_balanced, fit_sparse, score_of
from tollgate.routers.scoring import score_splits, with_assignment
from tollgate.routers.tfidf import HashedTfidfRouter, damped_by_hash, damped_by_term, damped_counts, gram_counts, hashed_counts, sparse_score, text_grams, vocabulary, weighted_features
from tollgate.session import written
from tollgate.sources.bundle import Bundle, load_bundle, save_router
from tollgate.sources.kept import keep

WORDS = ["river", "stone", "cloud", "lamp"]


@pytest.fixture(scope="module")
def toy(spark):
    """Hard questions carry a marker word."""
    rows = [
        (i, f"s{i % 6}", f"{'intricate ' if i % 2 == 0 else 'plain '}{WORDS[i % 4]} {'x' * (i % 9)}", i % 3 == 0 and i % 2 == 1, i % 2 == 0, i % 2 == 0)
        for i in range(80)
    ]
    return spark.createDataFrame(rows, "id long, subject string, prompt string, weak_correct boolean, strong_correct boolean, need_strong boolean")


@pytest.fixture(scope="module")
def store(spark, toy):
    rows = [(i, [1.0 if i % 2 == 0 else -1.0, math.sin(i), 0.5]) for i in range(80)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def python_grams(text):
    grams = []
    for word in text.lower().split():
        word = f" {word} "
        for n in range(2, 6):
            grams += [word[i : i + n] for i in range(len(word) - n + 1)]
    return grams


@pytest.mark.parametrize("text", ["Hello  wOrld a", "", "  \n ", "سؤال صعب", "x\n\ny 😀z", "don't — stop"])
def test_char_grams(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(char_grams(F.col("t")).alias("g")).first().g
    assert Counter(got) == Counter(python_grams(text))


def test_features_equal_a_direct_computation(spark, toy):
    chosen = vocabulary(written(gram_counts(toy), "grams"), 80, 60, rows_per_bucket=7).collect()
    idf = {r.gram: r.idf for r in sorted(chosen, key=lambda r: (-r.tf, r.gram))}
    terms = list(idf)
    rows = toy.collect()
    docs = {r.id: Counter(python_grams(r.prompt)) for r in rows}
    df = Counter(g for d in docs.values() for g in d)
    tf = sum(docs.values(), Counter())
    expected = sorted((g for g in df if df[g] >= 2), key=lambda g: (-tf[g], g))[:60]
    assert terms == expected
    got = weighted_features(damped_counts(toy, terms), list(idf.values())).collect()
    for r in got:
        d = docs[r.id]
        x = np.array([(1 + math.log(d[g])) * (math.log(81 / (1 + df[g])) + 1) if d[g] else 0.0 for g in terms])
        assert r.features.toArray() == pytest.approx(x / np.linalg.norm(x))


def test_the_vocabularies_of_several_models_are_chosen_at_once(toy):
    by_part = written(gram_counts(toy.withColumn("model", F.col("id") % 3), ["model"]), "grams")
    n_docs = toy.groupBy((F.col("id") % 3).alias("model")).agg(F.count("*").alias("n_docs"))
    for limit in (1, 17, 10**6):
        got = {(r.model, r.gram, r.tf, round(r.idf, 9)) for r in vocabulary(by_part, n_docs, limit, ["model"]).collect()}
        one = {m: by_part.where(F.col("model") == m).drop("model") for m in range(3)}
        sizes = {r.model: r.n_docs for r in n_docs.collect()}
        want = {(m, r.gram, r.tf, round(r.idf, 9)) for m in range(3) for r in vocabulary(one[m], sizes[m], limit).collect()}
        assert got == want and (limit > 17 or len(got) == 3 * limit)


def test_features_need_no_python(toy):
    fitted = TfidfRouter(50).fit(toy)
    for scored in (fitted.score(toy), HashedTfidfRouter(1 << 10).fit(toy).score(toy)):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_hashed_features_equal_a_direct_computation(toy):
    from pyspark.ml.feature import HashingTF

    buckets = 512
    place = HashingTF(numFeatures=buckets, inputCol="x", outputCol="y").indexOf
    rows = toy.collect()
    docs = {r.id: Counter(place(g) for g in python_grams(r.prompt)) for r in rows}
    df = Counter(b for d in docs.values() for b in d)
    fitted = HashedTfidfRouter(buckets).fit(toy)
    assert fitted.idf == pytest.approx([math.log(81 / (1 + df[b])) + 1 if df[b] >= 2 else 0.0 for b in range(buckets)])
    for r in weighted_features(hashed_counts(toy, buckets), fitted.idf).collect():
        x = np.array([(1 + math.log(docs[r.id][b])) * fitted.idf[b] if docs[r.id][b] else 0.0 for b in range(buckets)])
        assert r.features.toArray() == pytest.approx(x / np.linalg.norm(x))


def test_scores_lie_between_0_and_1(toy, store):
    for router in (RandomRouter(), LengthRouter(), OracleRouter(), TfidfRouter(), EmbeddingRouter(store)):
        scores = router.fit(toy).score(toy).agg(F.count("score"), F.min("score"), F.max("score")).first()
        assert scores[0] == 80 and 0 <= scores[1] <= scores[2] <= 1


def test_learned_routers_find_an_obvious_pattern(toy, store):
    for router in (TfidfRouter(), HashedTfidfRouter(1 << 12), EmbeddingRouter(store)):
        means = dict(router.fit(toy).score(toy).groupBy("need_strong").agg(F.avg("score")).collect())
        assert means[True] > means[False] + 0.3


def test_random_router_is_seeded_and_ignores_layout(toy):
    a = sorted(RandomRouter(1).score(toy).select("id", "score").collect())
    assert a == sorted(RandomRouter(1).score(toy.repartition(5)).select("id", "score").collect())
    assert a != sorted(RandomRouter(2).score(toy).select("id", "score").collect())


def test_length_scores_count_equal_lengths_and_cover_all_lengths(spark):
    train = spark.createDataFrame([("b" * n,) for n in (2, 3, 3, 6)], "prompt string")
    asked = spark.createDataFrame([("c" * n,) for n in (1, 2, 3, 5, 6, 9)], "prompt string")
    fitted = LengthRouter().fit(train)
    for router in (fitted, FittedLengthRouter(fitted.counts, 1), FittedLengthRouter(fitted.counts, 2, 1)):
        assert {len(r.prompt): r.score for r in router.score(asked).collect()} == {1: 0.0, 2: 0.25, 3: 0.75, 5: 0.75, 6: 1.0, 9: 1.0}


def test_a_very_long_prompt_adds_one_step(spark):
    counts = spark.createDataFrame([(3, 2), (10**8, 1)], "length int, m bigint")
    fitted = FittedLengthRouter(counts)
    assert fitted.steps.count() == 1 and len(fitted.steps.first()["__steps"]) == 2
    asked = spark.createDataFrame([("x" * 3,), ("x" * 5000,), (None,)], "prompt string")
    assert [r.score for r in fitted.score(asked).orderBy("prompt").collect()] == [None, pytest.approx(2 / 3), pytest.approx(2 / 3)]


def plain_newton(x, y):
    """Coefficients and intercept of the balanced regression, one full step after the other."""
    a = np.c_[x, np.ones(len(y))]
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    w, ridge = np.zeros(a.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
    return w


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [1, 1, 20, 1]
    y = rng.random(300) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.3, 0.0] + 1))
    side = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(r, bool(c), int(s)) for r, c, s in zip(x.tolist(), y, side)], "embedding array<double>, need_strong boolean, side int")
    return x, y, side, df.repartition(5)


def test_dense_regression_equals_a_plain_solution(points):
    x, y, side, df = points
    sides = [F.lit(True), *[F.col("side") != s for s in range(3)]]
    models = fit_balanced(df, sides=sides)
    for model, rows in zip(models, [np.ones(300, bool), *[side != s for s in range(3)]]):
        assert np.r_[model.coefficients, model.intercept] == pytest.approx(plain_newton(x[rows], y[rows]), abs=1e-8)
    here = [F.col("side") == s for s in range(3)]
    for r in df.withColumn("score", score_of(F.col("embedding"), models[1:], here)).collect():
        m = models[1 + r.side]
        assert r.score == pytest.approx(1 / (1 + math.exp(-np.dot(r.embedding, m.coefficients) - m.intercept)))


def test_far_steps_are_halved(spark):
    x = np.array([[1000.0], [999.0], [-1000.0], [-998.0], [3.0], [1.0]])
    y = np.array([True, False, False, True, True, False])
    df = spark.createDataFrame([(r, bool(c)) for r, c in zip(x.tolist(), y)], "embedding array<double>, need_strong boolean")
    (model,) = fit_balanced(df)
    a, w = np.c_[x, np.ones(6)], np.r_[model.coefficients, model.intercept]
    gradient = a.T @ (1 / (1 + np.exp(-a @ w)) - y) + w * [1, 0]
    assert np.abs(gradient).max() < 1e-6


def test_uneven_vectors_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], True), ([1.0], False)], "embedding array<double>, need_strong boolean")
    with pytest.raises(Exception, match="one length"):
        fit_balanced(df)


def test_sums_of_tasks_are_added_in_levels(spark):
    df = spark.range(0, 1000, 1, 40)
    measure = lambda b: b.column(0).to_numpy().sum(keepdims=True).astype(float)
    assert summed(df, measure, (1,), driver_bytes=8)[0] == summed(df, measure, (1,))[0] == 499500


def test_sparse_regression_equals_newton(spark):
    rng = np.random.default_rng(6)
    n, d = 240, 40
    values = np.where(rng.random((n, d)) < 0.2, rng.gamma(2.0, 1.0, (n, d)), 0.0)
    values[3] = 0.0  # a row without features
    scales = np.stack([rng.gamma(2.0, 1.0, d), np.where(np.arange(d) % 3 == 0, 0.0, 1.0)])
    y = rng.random(n) < 1 / (1 + np.exp(-3 * (values[:, 0] - values[:, 1])))
    side = np.arange(n) % 4 != 0
    rows = [(Vectors.sparse(d, np.flatnonzero(v).tolist(), v[v > 0].tolist()), bool(c), bool(s)) for v, c, s in zip(values, y, side)]
    df = spark.createDataFrame(rows, ["damped", "need_strong", "side"]).repartition(5)
    models = fit_sparse(df, scales, sides=[F.lit(True), F.col("side")])
    for model, scale, mine in zip(models, scales, (np.ones(n, bool), side)):
        x = values * scale
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        assert np.r_[model.coefficients, model.intercept] == pytest.approx(plain_newton(x[mine], y[mine]), abs=1e-4)
    scored = sparse_score(weighted_features(df, scales[0].tolist()), models[0])
    x = values * scales[0]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = 1 / (1 + np.exp(-x @ models[0].coefficients - models[0].intercept))
    assert sorted(r.score for r in scored.collect()) == pytest.approx(sorted(want))


def test_one_class_cannot_be_fitted(toy, store):
    with pytest.raises(ValueError, match="both classes"):
        EmbeddingRouter(store).fit(toy.where("need_strong"))


def test_missing_vectors_are_an_error(toy, store):
    with pytest.raises(Exception, match="no stored vector"):
        with_embeddings(toy, store.where("id > 3")).collect()
    assert with_embeddings(toy, store).count() == 80


def test_a_plan_assigns_like_a_table_of_splits_and_moves_no_prompt(toy, store):
    plan = sampling.plan_splits(toy)
    rows = sorted((r.id, r.part, r.fold) for r in plan.assign(toy).collect())
    joined = with_assignment(toy, sampling.make_splits(toy))
    assert rows == sorted((r.id, r.part, r.fold) for r in joined.collect())
    text = plan.assign(toy)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    scores = {(r.setup, r.id): r.score for r in score_splits(toy, plan, "embedding", store=store).collect()}
    for fold in range(5):
        part = joined.join(store, "id")
        fitted = EmbeddingRouter().fit(part.where(F.col("fold") != fold))
        for r in fitted.score(part.where(F.col("fold") == fold)).collect():
            assert scores["unseen_subjects", r.id] == pytest.approx(r.score, abs=1e-9)


def test_every_row_is_scored_out_of_sample(toy, store):
    splits = sampling.make_splits(toy).persist()
    for name, options in (("length", {}), ("tfidf", {}), ("embedding", {"store": store})):
        scores = score_splits(toy, splits, name, **options).collect()
        assert Counter(r.setup for r in scores) == {"random": 24, "unseen_subjects": 80}
        assert len({(r.setup, r.id) for r in scores}) == 104


def test_tfidf_scores_of_splits_equal_separate_fits(toy):
    splits = sampling.make_splits(toy).persist()
    got = {r.id: r.score for r in score_splits(toy, splits, "tfidf").collect() if r.setup == "random"}
    part = toy.join(splits.where("setup = 'random'"), "id")
    fitted = TfidfRouter().fit(part.where("part = 'train'"))
    direct = {r.id: r.score for r in fitted.score(part.where("part = 'test'")).collect()}
    assert got.keys() == direct.keys()
    assert all(got[i] == pytest.approx(direct[i], abs=1e-3) for i in got)


def test_own_router_can_be_registered(toy):
    class Marker:
        def fit(self, train):
            return self

        def score(self, df):
            return df.withColumn("score", F.col("prompt").startswith("intricate").cast("double"))

    register_router("marker", Marker)
    try:
        scores = score_splits(toy, sampling.make_splits(toy), "marker")
        assert scores.where("score = cast(need_strong as double)").count() == 104
    finally:
        ROUTERS.pop("marker")


@pytest.mark.parametrize("name", ["random", "length", "tfidf", "tfidf_hashed", "embedding"])
def test_trained_routers_are_saved_and_loaded(spark, toy, store, tmp_path, name):
    router = ROUTERS[name](store) if name == "embedding" else ROUTERS[name]()
    bundle = route.train_router(toy, router, 40.0)
    save_router(bundle, str(tmp_path / "r"))
    again = load_bundle(spark, str(tmp_path / "r"))
    assert (again.threshold, again.pct_strong, again.n_train) == (bundle.threshold, 40.0, 80)
    rows = toy.join(store, "id")
    assert sorted(again.router.score(rows).select("id", "score").collect()) == sorted(
        bundle.router.score(rows).select("id", "score").collect()
    )
    sent = bundle.router.score(rows).where(F.col("score") >= bundle.threshold).count()
    assert name == "embedding" or name == "length" or abs(sent - 32) <= 1


def test_cut_off_can_be_overridden_and_short_questions_are_left_out(spark):
    texts = spark.createDataFrame([(1, "q\nA. x\nB. y"), (2, "q without options"), (3, "q\nA. only")], "id long, text string")
    bundle = Bundle(RandomRouter(), 0.5, 50.0, 0)
    assert [(r.id, r.role) for r in route.route_batch(texts, bundle, cut=0.0).collect()] == [(1, "strong")]
    assert [r.role for r in route.route_batch(texts, bundle, cut=1.1).collect()] == ["weak"]


ODD_TEXTS = ["Hello  wOrld a", "", None, "  \n ", "سؤال صعب", "x\n\ny 😀z", "don't — stop", "aaaa aaaaaa aaaa", "".join(map(chr, range(0x4E00, 0x6E00))), "Ünï\x85cödé\x1fzz"]


@pytest.mark.parametrize("chars", [1, 40, 1 << 20])
def test_counted_grams_are_those_of_char_grams(spark, monkeypatch, chars):
    table = spark.createDataFrame([(i, i % 3 or None, t) for i, t in enumerate(2 * ODD_TEXTS)], "id long, side long, prompt string").coalesce(2)
    each = table.select("id", "side", F.explode(char_grams(F.col("prompt"))).alias("gram"))
    plain = each.groupBy("id", "gram").agg(F.count("*").alias("n"))
    parts = list(grams.chunks(ODD_TEXTS))
    monkeypatch.setattr(grams, "CHARS_PER_CHUNK", chars)
    assert len(list(grams.chunks(ODD_TEXTS))) >= len(parts) == 1
    assert Counter(text_grams(table).collect()) == Counter(plain.collect())
    # The texts are shuffled, not the grams.
    assert text_grams(table)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    twice = text_grams(table.select((F.col("id") % 10).alias("id"), "prompt"))
    assert Counter(twice.collect()) == Counter(plain.groupBy((F.col("id") % 10).alias("id"), "gram").agg(F.sum("n").alias("n")).collect())
    sums = each.groupBy("gram", "side").agg(F.count("*").alias("tf"), F.count_distinct("id").alias("df"))
    assert Counter(gram_counts(table, ["side"]).collect()) == Counter(sums.collect())


def test_tallies_with_many_letters_and_hashes_of_the_library(spark, monkeypatch):
    texts = [t for t in ["\n".join(f" {w} " for w in (t or "").lower().split()) for t in ODD_TEXTS]]
    wide = [(t.grams.take(t.gram).to_pylist(), t.row.tolist(), t.count.tolist()) for t in grams.tallies(texts)]
    monkeypatch.setattr(grams, "KEY_BITS", 0)
    nested = [(t.grams.take(t.gram).to_pylist(), t.row.tolist(), t.count.tolist()) for t in grams.tallies(texts[:8])]
    monkeypatch.setattr(grams, "KEY_BITS", 62)
    packed = [(t.grams.take(t.gram).to_pylist(), t.row.tolist(), t.count.tolist()) for t in grams.tallies(texts[:8])]
    assert [Counter(zip(*x)) for x in nested] == [Counter(zip(*x)) for x in packed]
    assert sum(sum(c) for _, _, c in wide) == sum(len(python_grams(t or "")) for t in ODD_TEXTS)
    strings = [g for x in wide for g in x[0]][:3000] + ["a", "abcd", "é", "€uro", "😀😀😀😀😀"]
    table = spark.createDataFrame([([s],) for s in strings], "w array<string>")
    library = HashingTF(numFeatures=1 << 18, inputCol="w", outputCol="v").transform(table).select(F.unwrap_udt("v")["indices"][0].alias("i")).collect()
    assert (grams.murmur3(pa.array(strings)) % (1 << 18)).tolist() == [r.i for r in library]


def test_training_counts_are_those_of_the_transformers(spark):
    table = spark.createDataFrame([(i, t or "") for i, t in enumerate(ODD_TEXTS)], "id long, prompt string")
    terms = sorted({g for t in ODD_TEXTS for g in python_grams(t or "")})[::2]
    for fast, plain in ((damped_by_term(table, terms), damped_counts(table, terms)), (damped_by_hash(table, 64), hashed_counts(table, 64))):
        assert fast.schema == plain.schema
        want = {r.id: r.damped for r in plain.collect()}
        for r in fast.collect():
            assert r.damped.size == want[r.id].size and r.damped.indices.tolist() == want[r.id].indices.tolist()
            assert r.damped.values == pytest.approx(want[r.id].values)


def test_sparse_blocks_stay_small_and_hold_every_row(spark, monkeypatch):
    """A block used to hold all rows of a batch."""
    monkeypatch.setattr(regression, "BLOCK_ENTRIES", 50)
    rows = [(list(range(i % 4 * 5)), [1.0 + j for j in range(i % 4 * 5)], [i % 2, 1]) for i in range(200)]
    table = spark.createDataFrame(rows, "indices array<int>, vals array<double>, marks array<tinyint>").coalesce(1)
    blocks = regression._packed_sparse(table, np.ones((1, 15))).select(F.length("indices") / 4, F.length("lengths") / 4).collect()
    assert max(r[0] for r in blocks) <= 50 + 16 + 20 and len(blocks) > 20
    assert sum(r[1] for r in blocks) == 200 and sum(r[0] for r in blocks) == 50 * (1 + 5 + 10 + 15)


def test_texts_of_large_files_are_counted_in_tasks_with_the_same_values(spark, toy, tmp_path, monkeypatch):
    """They went through regular expressions and JSON, some ten times the time."""
    toy.write.parquet(str(tmp_path / "t"))
    files, terms = spark.read.parquet(str(tmp_path / "t")), sorted({g for w in WORDS for g in python_grams(w)})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for counted in (lambda df: damped_counts(df, terms), lambda df: hashed_counts(df, 64)):
        assert "Arrow" not in plan(counted(files)) and "Arrow" not in plan(counted(toy))
        monkeypatch.setattr(tfidf, "TASK_BYTES", 100)
        assert "MapInArrow" in plan(counted(files)) and "Arrow" not in plan(counted(toy))
        want = {r.id: r.damped for r in counted(toy).collect()}
        for r in counted(files).collect():
            assert r.damped.indices.tolist() == want[r.id].indices.tolist() and r.damped.values == pytest.approx(want[r.id].values)
        monkeypatch.undo()


def test_packed_rows_take_three_bytes_an_entry_and_hold_everything(monkeypatch):
    """An entry used to take twelve bytes."""
    size = 3 * regression.SEGMENT + 7
    counts = [{}, {5: 1, 65535: 255, 65536: 256, 196612: 70000}, {}, {i: 1 + i % 300 for i in range(0, size, 97)}, {size - 1: 2}, {}]
    entries = np.array([(r, p, n) for r, found in enumerate(counts) for p, n in sorted(found.items())])
    scales = np.random.default_rng(1).random((2, size))
    packed = regression.packed_counts(*entries.T, len(counts), scales)
    sizes = [regression._sizes(x) for x in packed.flatten()[:3]]
    assert (sizes[1] + sizes[2]).tolist() == [3 * len(c) for c in counts]
    marks = pa.array([[i % 2, 1, int(i < 4)] for i in range(len(counts))], pa.list_(pa.int8()))
    for tile in (1, 100, 1 << 20):
        monkeypatch.setattr(regression, "TILE_ENTRIES", tile)
        rows = []
        for lengths, starts, index, value, norms, y, mine in regression._tiles(pa.RecordBatch.from_arrays([packed, marks], names=["a", "b"])):
            assert len({tuple(m[1:]) for m in mine.tolist()}) == 1
            for i, (start, n) in enumerate(zip(starts, lengths)):
                rows.append((index[start : start + n].tolist(), value[start : start + n], norms[:, i], y[i], mine[i].tolist()))
        assert [r[0] for r in rows] == [sorted(c) for c in counts] and [r[4] for r in rows] == marks.to_pylist()
        for found, (places, values, norms, y, mine) in zip(counts, rows):
            want = 1 + np.log([found[p] for p in places])
            assert values == pytest.approx(want) and y == mine[0]
            assert norms == pytest.approx([np.linalg.norm(want * s[places]) or 1.0 for s in scales])


def test_packed_counts_are_fitted_and_scored_like_vectors(spark, toy, tmp_path, monkeypatch):
    toy.write.parquet(str(tmp_path / "t"))
    files, terms = spark.read.parquet(str(tmp_path / "t")), sorted({g for r in toy.collect() for g in python_grams(r.prompt)})
    scales = np.stack([np.ones(len(terms)), np.arange(len(terms)) % 3 / 2.0])
    sides = [F.lit(True), F.col("id") % 5 != 0]
    packed = tfidf.packed_by_term(toy.select("prompt", regression.marks_of("need_strong", sides).alias("marks")).repartition(3), terms, scales)
    assert len(packed.paths) == 3
    for a, b in zip(fit_sparse(packed, scales), fit_sparse(damped_by_term(toy, terms), scales, sides=sides)):
        assert np.r_[a.coefficients, a.intercept] == pytest.approx(np.r_[b.coefficients, b.intercept], abs=1e-4)
    for router in (TfidfRouter(200), HashedTfidfRouter(1 << 10)):
        fitted = router.fit(toy)
        want = {r.id: r.score for r in fitted.score(toy).collect()}
        monkeypatch.setattr(tfidf, "TASK_BYTES", 100)
        scored = fitted.score(files)
        assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString() and scored.columns == [*toy.columns, "score"]
        assert {r.id: r.score for r in scored.collect()} == pytest.approx(want)
        monkeypatch.undo()


def test_few_passes_fit_a_sparse_model(spark, monkeypatch):
    """Newton steps took a pass for each of their conjugate gradients: 62 here."""
    rng = np.random.default_rng(8)
    n, d = 3000, 400
    values = np.where(rng.random((n, d)) < np.minimum(0.9, 20 / np.arange(1, d + 1)), rng.integers(1, 9, (n, d)), 0)
    y = rng.random(n) < 1 / (1 + np.exp(-0.3 * values @ rng.normal(size=d) / np.sqrt(20)))
    row, place = np.nonzero(values)
    scales = rng.gamma(2.0, 1.0, (1, d))
    marks = pa.array([[int(c), 1] for c in y], pa.list_(pa.int8()))
    rows = pa.RecordBatch.from_arrays([marks, regression.packed_counts(row, place, values[row, place], n, scales)], names=["marks", "damped"])
    kept = keep(spark.range(0, 2, 1, 2), lambda batches: (rows.slice(1500 * i, 1500) for b in batches for i in b.column(0).to_pylist()), "counts")
    passes = []
    monkeypatch.setattr(regression, "summed", lambda *a: passes.append(1) or summed(*a))
    (model,) = fit_sparse(kept, scales)
    x = np.where(values > 0, 1 + np.log(np.maximum(values, 1)), 0.0) * scales
    assert np.r_[model.coefficients, model.intercept] == pytest.approx(plain_newton(x / np.linalg.norm(x, axis=1, keepdims=True), y), abs=1e-4)
    assert len(passes) < 45
