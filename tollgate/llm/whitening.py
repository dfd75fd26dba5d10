"""Whitening of vectors by the leading eigenvectors of their covariance, found by Chebyshev-filtered subspace iteration.

Components become x = floor(scale * c) + shift. The vectors are staged once as blocks of small integers, and a pass over
the blocks gives V Q for a few columns Q, where V is the covariance: each block is centred and multiplied twice, and the
tasks' results are added up. Nothing else is done with the rows until the components are known.

Lanczos steps bound the spectrum. Then rounds follow, on somewhat more columns than are wanted: a Chebyshev polynomial of V, by its
three-term recurrence with a pass for each degree, damps everything between the lower bound and the smallest Ritz value
held; QR makes the columns orthonormal; Rayleigh-Ritz gives eigenvalue estimates. Leading pairs whose residual
is within ``tolerance`` of the largest eigenvalue are left out of further filters. When all wanted pairs are there, a round from fresh
random columns beside them must find nothing larger; then they are certified. Rounds that do not come nearer widen the block, at last to the
whole space, where Rayleigh-Ritz is exact.

Defined cases: a vector that is null or holds null or non-finite entries is dropped; null ids, repeated ids and repeated rows stay, each
with rows of its own. Vectors shorter than the longest end in zeros (c = 0). 64-bit limits hold entries beyond them. A direction in which the
vectors do not vary (eigenvalue within rounding of zero) cannot be whitened and gives no rows: a single vector, or equal ones, give
an empty result. ``deviation`` is null where it does not fit into a long. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.topk import scaled
from tollgate.llm.vectors import LONG, exact_totals, fitting, magnitude, matrix, summed
from tollgate.session import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, GUARD = 32, 16
TOLERANCE = 1e-12
#: Eigenvalues below this share of the largest are rounding.
RANK_TOLERANCE = 1e-11
LANCZOS_STEPS = 10
MAX_DEGREE = 16
#: A filter must not raise the first of its columns above the last wanted one by more than this.
MAX_RANGE = 1e8
SEED = 11
Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Eigenpairs:
    """``passes`` counts products with the covariance; ``residual`` is the largest, relative to the largest eigenvalue."""

    values: np.ndarray
    vectors: np.ndarray
    passes: int
    residual: float


def bounds(product: Product, d: int, rng: np.random.Generator) -> tuple[float, float]:
    """Below and above the spectrum, from a few Lanczos steps and their residual."""
    basis, alpha, beta = [unit(rng.normal(size=d))], [], []
    for _ in range(min(d, LANCZOS_STEPS)):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            for q in basis:
                w = w - (q @ w) * q
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-14 * max(map(abs, alpha)) or len(basis) == d:
            break
        basis.append(w / beta[-1])
    n = len(alpha)
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: n - 1], 1) + np.diag(beta[: n - 1], -1))
    return max(0.0, float(ritz[0]) - beta[-1]), float(ritz[-1]) + beta[-1]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def chebyshev(product: Product, x: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the interval [low, cut] at V, times x; scaled to about 1 at ``top``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - middle)
    y = (product(x) - middle * x) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        x, y = y, 2 * (product(y) - middle * y) * (following / half) - sigma * following * x
        sigma = following
    return y


def orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """QR of the columns, made orthogonal to ``against``."""
    for _ in range(2):
        columns = columns - against @ (against.T @ columns)
        columns = np.linalg.qr(columns / np.maximum(np.linalg.norm(columns, axis=0), 1e-300))[0]
    return columns


def leading(multiply: Product, d: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, seed: int = SEED) -> Eigenpairs:
    """The k largest eigenvalues, falling, and their eigenvectors of a symmetric matrix without negative eigenvalues that is
    known by its products only."""
    passes = 0

    def product(x: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return multiply(x)

    rng = np.random.default_rng(seed)
    k, size = min(k, d), min(d, k + guard)
    low, _ = bounds(product, d, rng) if size < d else (0.0, 0.0)
    q = orthonormal(rng.normal(size=(d, size)), np.zeros((d, 0)))
    vq = product(q)
    confirmed, best, idle = False, math.inf, 0
    while True:
        h = q.T @ vq
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        residual = np.linalg.norm(vq - q * values, axis=0)
        largest = max(float(values[0]), 0.0)
        good = residual[:k] <= tolerance * largest
        done = k if good.all() else int(np.argmin(good))
        if size == d or (done == k and confirmed):
            return Eigenpairs(values[:k], q[:, :k], passes, float(residual[:k].max() / largest) if largest else 0.0)
        worst = float(residual[:k].max())
        idle = 0 if worst < best / 2 or done == k else idle + 1
        best = min(best, worst)
        kept = q[:, :done]
        if confirmed := done == k:
            active = orthonormal(rng.normal(size=(d, size - k)), kept)
        elif idle < 3:
            active = q[:, done:]
        else:  # no nearer: trust no lower bound, and hold more columns
            low, idle, best, size = 0.0, 0, math.inf, min(d, size + max(guard, k // 2))
            active = np.concatenate([q[:, done:], orthonormal(rng.normal(size=(d, size - q.shape[1])), q)], axis=1)
        cut = float(values[-1])
        half, middle = (cut - low) / 2, (cut + low) / 2
        if half <= 1e-14 * largest:  # all that is left is one eigenvalue
            low, half, middle = 0.0, cut / 2, cut / 2
        if half > 0 and size < d:
            growth = lambda value: math.acosh(max((value - middle) / half, 1 + 1e-9))
            top, last = float(values[min(done, k - 1)]), float(values[k - 1])
            wanted = math.log(max(worst / (tolerance * largest), 10.0)) + 1
            most = math.log(MAX_RANGE) / max(growth(top) - growth(last), 1e-9)
            degree = int(max(1, min(MAX_DEGREE, most, math.ceil(wanted / growth(last)))))
            active = chebyshev(product, active, degree, low, cut, max(top, cut * (1 + 1e-9)))
        active = orthonormal(active, kept)
        q, vq = np.concatenate([kept, active], axis=1), np.concatenate([vq[:, :done], product(active)], axis=1)


@dataclass
class Whitener:
    """``count`` vectors with ``totals`` per dimension were fitted. ``directions`` are the eigenvectors, as columns."""

    count: int
    totals: list[int]
    pairs: Eigenpairs
    trace: float
    identity_error: float

    @property
    def used(self) -> int:
        values = self.pairs.values
        return int((values > RANK_TOLERANCE * max(values[0], 0.0)).sum()) if len(values) else 0

    @property
    def directions(self) -> np.ndarray:
        return self.pairs.vectors[:, : self.used]

    @property
    def scales(self) -> np.ndarray:
        return np.sqrt(self.pairs.values[: self.used])


def blocks(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """Staged blocks (ids, data) of floor(scale * c), the number of vectors, and their width."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("vector")).where("vector is not null")
    count, width = rows.agg(F.count("*"), F.greatest(F.max(F.size("vector")), F.lit(1))).first()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch.column(1), width)
            small = next(t for t in ("<i1", "<i2", "<i4", "<i8") if magnitude(values) <= np.iinfo(t).max or t == "<i8")
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([values.astype(small).tobytes()], pa.binary())], names=["ids", "data"])

    return written(rows.mapInArrow(pack, "ids array<long>, data binary"), "vectors"), count, width


def unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for ids, data in zip(batch.column("ids"), batch.column("data").to_pylist(), strict=True):
        n = len(ids.values)
        yield ids.values, np.frombuffer(data, dtype=f"<i{len(data) // max(1, n * width)}").reshape(n, width).astype(np.int64)


def centred(values: np.ndarray, totals: list[int], count: int) -> np.ndarray:
    """values - totals / count, where the whole part of the mean is taken off exactly."""
    whole = [t // count for t in totals]
    rest = np.array([t % count / count for t in totals])
    if magnitude(values) < 1 << 62 and max(map(abs, whole), default=0) < 1 << 62:
        return (values - np.array(whole, dtype=np.int64)) - rest
    return values.astype(np.float64) - np.array(whole, dtype=np.float64) - rest


def deviations(values: np.ndarray, totals: list[int], count: int) -> pa.Array:
    """Sum of (count * x - total) ** 2 of each vector, exactly; null where it is no long."""
    most = count * (magnitude(values) + max((abs(t) // count + 1 for t in totals), default=0))
    if most * most * max(1, len(totals)) < 1 << 62:
        off = count * values - np.array(totals, dtype=np.int64)
        return pa.array((off * off).sum(axis=1), LONG)
    off = count * values.astype(object) - np.array(totals, dtype=object)
    return fitting(((off * off).sum(axis=1) if len(totals) else np.zeros(len(values), dtype=object)).tolist())


def fit(staged: DataFrame, count: int, width: int, components: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE) -> Whitener:
    """The whitener of staged blocks. A shift of all components changes nothing here, so it is left out."""

    def column_sums(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(width, dtype=object)
        for _, values in unpacked(batch, width):
            total += values.sum(axis=0).astype(object) if magnitude(values) * len(values) < 1 << 62 else values.astype(object).sum(axis=0)
        return total

    if not count:
        return Whitener(count, [0] * width, Eigenpairs(np.zeros(0), np.zeros((width, 0)), 0, 0.0), 0.0, 0.0)
    data = staged.select("ids", "data")
    totals = exact_totals(data, column_sums, width)

    def over_rows(measure: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        def run(batch: pa.RecordBatch) -> np.ndarray:
            return sum((measure(centred(values, totals, count)) for _, values in unpacked(batch, width)), np.zeros(shape))

        return summed(data, run, shape) / count

    trace = float(over_rows(lambda x: np.array([np.vdot(x, x)]), (1,))[0])
    pairs = leading(lambda q: over_rows(lambda x: x.T @ (x @ q), (width, q.shape[1])), width, components, guard, tolerance)
    out = Whitener(count, totals, pairs, trace, 0.0)
    if out.used:
        turn = out.directions / out.scales
        moments = over_rows(lambda x: np.concatenate([(w := x @ turn).T @ w, w.sum(axis=0)[None]]), (out.used + 1, out.used))
        out.identity_error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(out.used)).max())
    return out


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    guard: int = GUARD,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, Whitener]:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component, and the whitener."""
    staged, count, width = blocks(vectors, scale, id_col, vector_col)
    model = fit(staged, count, width, components, guard, tolerance)
    k, totals = model.used, model.totals
    turn = model.directions / model.scales if k else np.zeros((width, 0))
    explained, error = model.pairs.values[:k] / model.trace if k else np.zeros(0), model.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values in unpacked(batch, width):
                rows = len(ids)
                each = np.repeat(np.arange(rows), k)
                columns = [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, count), LONG),
                    deviations(values, totals, count).take(pa.array(each)),
                    pa.array((centred(values, totals, count) @ turn).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return staged.mapInArrow(project, schema), model
