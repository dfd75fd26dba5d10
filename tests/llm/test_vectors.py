"""Whitening and vector codes against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label string"


def table(spark, rows, parts=4):
    extra = {c: F.lit(7) for c in ("n", "codes", "ids", "data", "error", "total", "of_label", "vector")}
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns(extra)


def some_rows(seed, n, width):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(width, width)) * np.linspace(1, 0.2, width)
    rows = [(i, (rng.normal(size=width) @ mix).tolist(), "abc"[i % 3] if i % 7 else None) for i in range(n)]
    odd = [(n, None, "a"), (n + 1, [1.0] * (width - 1) + [None], "a"), (n + 2, [math.nan] * width, None), (n + 3, [math.inf] + [0.0] * (width - 1), "b")]
    return rows + odd + [(None, rows[0][1], "a"), (None, rows[1][1], None), rows[5], rows[5], (5, rows[6][1], "c")]


def kept(rows, scale, width):
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v)), label) for i, v, label in good]


def leading_of(v, k):
    return whitening.leading(lambda x: v @ x, len(v), k)


@pytest.mark.parametrize("values", [np.linspace(9, 1, 60), np.r_[np.full(8, 5.0), np.full(52, 5.0 - 1e-3)], 10.0 ** -np.arange(0, 12, 0.2), np.r_[np.ones(3), np.zeros(57)], np.ones(60), np.zeros(60)])
def test_eigenpairs_of_many_spectra(values):
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(60, 60)))[0]
    v = q * values @ q.T
    found = leading_of(v, 10)
    np.testing.assert_allclose(found.values, np.sort(values)[::-1][:10], atol=1e-11 * max(values.max(), 1e-9))
    np.testing.assert_allclose(found.vectors.T @ found.vectors, np.eye(10), atol=1e-12)
    assert np.linalg.norm(v @ found.vectors - found.vectors * found.values) <= 1e-11 * max(values.max(), 1e-9)


def test_no_more_columns_than_dimensions():
    v = np.diag([3.0, 2.0, 1.0])
    found = leading_of(v, 10)
    np.testing.assert_allclose(found.values, [3, 2, 1])


def test_whitening(spark):
    width, rows = 60, some_rows(1, 300, 60)
    out, model = whitening.whiten(table(spark, rows), components=8, guard=6)
    assert model.pairs.passes > 10 and model.pairs.residual <= whitening.TOLERANCE
    plain = kept(rows, 64, width)
    x = np.array([v for _, v, _ in plain], dtype=np.float64)
    n, sums = len(x), [sum(v[j] for _, v, _ in plain) for j in range(width)]
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    white = (x - x.mean(axis=0)) @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    got = defaultdict(list)
    for r in out.collect():
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[::-1][r.component - 1] / values.sum(), rel=1e-9)
        got[r.vec_id, r.deviation, r.component].append(r.whitened)
    expected = defaultdict(list)
    for (i, v, _), w in zip(plain, white, strict=True):
        for c in range(8):
            expected[i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), c + 1].append(w[c])
    assert got.keys() == expected.keys()
    signs = [np.sign(np.vdot(model.directions[:, c], axes[:, ::-1][:, c])) for c in range(8)]
    for key, found in got.items():
        np.testing.assert_allclose(sorted(found), sorted(signs[key[2] - 1] * w for w in expected[key]), atol=1e-8)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(table(spark, []))[0].collect() == []
    assert whitening.whiten(table(spark, [(1, None, None)]))[0].collect() == []
    assert whitening.whiten(table(spark, [(1, [], None), (2, [], None)]))[0].collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], None)] * 3))[0].collect() == []  # nothing varies
    short = whitening.whiten(table(spark, [(1, [1.0], None), (2, [1.0, 2.0], None), (3, [3.0, 0.0], None)]))[0].collect()
    assert Counter(r.vec_id for r in short) == {1: 2, 2: 2, 3: 2} and short[0].n == 3
    huge = whitening.whiten(table(spark, [(1, [1e300, 1.0], None), (2, [0.0, -1e300], None), (3, [5.0, 1.0], None)]))[0].collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.deviation is None and math.isfinite(r.whitened) for r in huge)


def test_sums_are_added_in_levels(spark):
    df = spark.range(0, 1000, 1, 40)
    measure = lambda b: b.column(0).to_numpy().sum(keepdims=True).astype(float)
    assert vectors.summed(df, measure, (1,), driver_bytes=8)[0] == vectors.summed(df, measure, (1,))[0] == 499500
    assert vectors.exact_totals(df, lambda b: np.array([10**30, int(b.column(0).to_numpy().sum())], dtype=object), 2)[1] == 499500


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    width = -(-width // parts) * parts
    points = sorted(kept(rows, scale, width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, v, _ in points]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, a: min((away(a, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == k]
                if mine:
                    books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(points, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(points, found, errors, strict=True))


def coded(spark, rows, **options):
    return Counter(tuple(r) for r in vector_codes.compress(table(spark, rows), **options).collect())


def test_codes(spark):
    rows = some_rows(3, 400, 32)
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, rows, parts=3, entries=5, rounds=4) == plain_codes(rows, parts=3, entries=5, rounds=4)


def test_codes_of_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) / 256 for x in rng.integers(-2, 3, 16)], None) for i in range(300)] + [(400 + i, [0.0] * 16, "x") for i in range(300)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    assert coded(spark, []) == Counter() == coded(spark, [(1, None, None)])
    for rows in ([(1, [], None)], [(1, [1.0], "a"), (2, [0.5, -3.0, 2.0], None)], [(None, [0.1] * 16, None)] * 3):
        assert {r[:3] for r in coded(spark, rows)} == {r[:3] for r in plain_codes(rows)}
    huge = vector_codes.compress(table(spark, [(1, [1e300] * 16, "a"), (2, [-1e300] * 16, "a"), (3, [0.0] * 16, "b")]), entries=2).collect()
    assert {(r.vec_id, r.code[:2]) for r in huge} == {(1, "00"), (2, "01"), (3, "00")}
    assert {r.label_error for r in huge} == {None}


def test_balls_save_distances_and_lose_nothing():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (4, 32, 4))
    points = np.stack([centres[p][rng.integers(0, 32, 5000)] for p in range(4)], axis=1) + rng.integers(-300, 300, (5000, 4, 4))
    books = vector_codes.Codebooks(centres)
    full = ((points[:, :, None] - centres[None]) ** 2).sum(axis=-1)
    codes, away, taken = books.assign(points, None)
    assert (codes == full.argmin(axis=2)).all() and (away == full.min(axis=2)).all()
    again, _, less = vector_codes.Codebooks(centres, np.ones((4, 32), dtype=bool)).assign(points, codes)
    assert (again == codes).all() and less == points.shape[0] * 4 < taken < full.size
    one = centres.copy()
    one[0, 0] += 500
    moved = vector_codes.Codebooks(one, (one == centres).all(axis=2))
    new, near, some = moved.assign(points, codes)
    full = ((points[:, :, None] - one[None]) ** 2).sum(axis=-1)
    assert (new == full.argmin(axis=2)).all() and (near == full.min(axis=2)).all() and some < taken
