"""Class-balanced L2 logistic regression, by Newton steps over dense vectors and by L-BFGS over sparse ones.

The rows are packed once into blocks. Dense: a step is one pass: each task adds up the gradient and
the curvature of its blocks, a matrix as wide as the vectors, and the driver solves the
small system; some eight passes suffice. Sparse: the curvature is known by its products only, a pass each, so one step is solved by conjugate
gradients and the others follow from what the steps so far have met of it. All models of a split are fitted in the same passes.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tollgate.operators.sums import summed
from tollgate.session import written
from tollgate.sources.kept import Kept

# Newton decrement, against the size of the objective, below which the last step is taken.
TOLERANCE = 1e-18
MAX_PASSES = 200


@dataclass(frozen=True)
class Linear:
    """A fitted model: the score is the logistic function of the weighted sum."""

    coefficients: tuple[float, ...]
    intercept: float

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w) for i, w in enumerate([*self.coefficients, self.intercept])]
        spark.createDataFrame(rows, "position int, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Linear":
        *coefficients, intercept = [r["weight"] for r in spark.read.parquet(path).orderBy("position").collect()]
        return cls(tuple(coefficients), intercept)


def logistic(vector: Column, coefficients: Column, intercept: Column) -> Column:
    """1 / (1 + exp(-(coefficients . vector + intercept)))."""
    products = F.zip_with(vector, coefficients, lambda x, w: x.cast("double") * w)
    return 1 / (1 + F.exp(-F.aggregate(products, intercept, lambda s, x: s + x)))


def score_of(vector: Column, models: Sequence[Linear], which: Sequence[Column]) -> Column:
    """The score by the first model whose condition in ``which`` holds."""
    weights = F.lit(None).cast("array<double>")
    intercept = F.lit(None).cast("double")
    for model, here in reversed(list(zip(models, which))):
        weights = F.when(here, F.lit(list(model.coefficients)).cast("array<double>")).otherwise(weights)
        intercept = F.when(here, F.lit(model.intercept)).otherwise(intercept)
    return logistic(vector, weights, intercept)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Blocks (x, y) of rows (vector, marks): ``x`` as doubles, ``y`` the label and then, for each model, whether it is trained on the row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, marks = batch.columns
            if vectors.flatten().null_count or not (vectors.value_lengths().to_numpy() == width).all():
                raise ValueError("vectors must have one length and no nulls")
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            y = marks.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([y.tobytes()])], names=["x", "y"])

    return rows.mapInArrow(pack, "x binary, y binary")


def _unpacked(batch: pa.RecordBatch, width: int, models: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        x = np.frombuffer(x, dtype="<f8").reshape(-1, width)
        yield np.column_stack([x, np.ones(len(x))]), np.frombuffer(y, dtype=np.uint8).reshape(-1, 1 + models)


def _measure(batch: pa.RecordBatch, at: np.ndarray, class_weights: np.ndarray, models: list[int]) -> np.ndarray:
    """For each of ``models``: loss, gradient and curvature at its weights, one after the other."""
    wide = at.shape[1]
    out = np.zeros((len(models), 1 + wide + wide * wide))
    for x, y in _unpacked(batch, wide - 1, len(class_weights)):
        for row, m in enumerate(models):
            mine = y[:, 1 + m] > 0
            a, label = x[mine], y[mine, 0].astype(float)
            weight = np.where(label > 0, class_weights[m, 1], class_weights[m, 0])
            z = a @ at[m]
            p = 0.5 * (1 + np.tanh(z / 2))  # cannot overflow
            out[row, 0] += weight @ (np.logaddexp(0, z) - label * z)
            out[row, 1 : 1 + wide] += a.T @ (weight * (p - label))
            out[row, 1 + wide :] += (a.T @ (a * (weight * p * (1 - p))[:, None])).ravel()
    return out


def fit_balanced(
    rows: DataFrame,
    vector: str = "embedding",
    label: str = "need_strong",
    sides: Sequence[Column] | None = None,
    c: float = 1.0,
) -> list[Linear]:
    """One model for each of ``sides``, a condition on its training rows (default: one model, all rows).

    Minimises half |w|^2 plus c times the loss, in which both classes of a side have the same weight;
    the intercept is not shrunk."""
    sides = [F.lit(True)] if sides is None else list(sides)
    marks = F.transform(F.array(F.col(label), *sides), lambda x: F.coalesce(x, F.lit(False)).cast("tinyint"))
    rows = rows.select(F.col(vector).cast("array<double>").alias("vector"), marks.alias("marks"))
    counts = [F.sum(F.get("marks", F.lit(1 + m))) for m in range(len(sides))]
    positives = [F.sum(F.get("marks", F.lit(1 + m)) * F.get("marks", F.lit(0))) for m in range(len(sides))]
    rows = written(rows, "training")
    width, *numbers = rows.agg(F.max(F.size("vector")), *counts, *positives).first()
    n, p = np.array(numbers[: len(sides)], dtype=object), np.array(numbers[len(sides) :], dtype=object)
    if any(not a or not 0 < b < a for a, b in zip(n, p)):
        raise ValueError("training rows need both classes")
    class_weights = np.array([[a / (2 * (a - b)), a / (2 * b)] for a, b in zip(n, p)])
    blocks = written(_packed(rows, width), "blocks")
    wide = width + 1
    ridge = np.append(np.ones(width), 0.0)

    at = np.zeros((len(sides), wide))
    base, steps = at.copy(), np.zeros_like(at)  # where the last accepted pass was, and the step from there
    best = np.full(len(sides), np.inf)
    active = list(range(len(sides)))
    for _ in range(MAX_PASSES):
        here, models = at.copy(), list(active)
        got = summed(
            blocks,
            lambda batch: _measure(batch, here, class_weights, models),
            (len(models), 1 + wide + wide * wide),
        )
        for row, m in enumerate(models):
            w = at[m]
            value = c * got[row, 0] + 0.5 * (ridge * w) @ w
            if value > best[m] + 1e-12 * abs(best[m]):  # too far: half the way
                steps[m] /= 2
                at[m] = base[m] + steps[m]
                continue
            gradient = c * got[row, 1 : 1 + wide] + ridge * w
            curvature = c * got[row, 1 + wide :].reshape(wide, wide) + np.diag(ridge)
            step = -np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            base[m], best[m], steps[m] = w.copy(), value, step
            at[m] = w + step
            if -(gradient @ step) <= TOLERANCE * max(1.0, abs(value)):
                active.remove(m)
        if not active:
            return [Linear(tuple(w[:-1].tolist()), float(w[-1])) for w in at]
    raise ValueError(f"no minimum after {MAX_PASSES} passes")


# --- sparse ----------------------------------------------------------------------------------

# Length of the gradient, against the first one, at which a model is done.
GRADIENT_TOLERANCE = 1e-6
FIRST_STEPS = 10
SPARSE_PASSES = 1000
# Memory of a fit for the steps it keeps, and bounds of their number for each model.
STEP_BYTES, FEWEST_STEPS, MOST_STEPS = 64 << 20, 10, 100
PASSES_PER_DIAGONAL = 10
SPARSE_DRIVER_BYTES = 128 << 20
SPARSE_BATCH_BYTES = 8 << 20
BLOCK_ENTRIES = 1 << 20
TILE_ENTRIES = 1 << 17
SEGMENT = 1 << 16
BLOCK = ("lengths", "indices", "vals", "norms", "marks")


def _packed_sparse(rows: DataFrame, scales: np.ndarray) -> DataFrame:
    """Blocks of rows (indices, values, marks), with the length that each row has in each model; rows without features
    get one with value 0. A block has about ``BLOCK_ENTRIES`` entries, so it is small however many rows a batch has."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(ends // BLOCK_ENTRIES, append=-1)) + 1
            for start, end in zip([0, *cuts], cuts):
                yield block(batch.slice(start, end - start))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        empty = np.flatnonzero(lengths == 0)
        at = np.cumsum(lengths)[empty]
        index = np.insert(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int32), at, 0)
        value = np.insert(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), at, 0.0)
        lengths[empty] = 1
        starts = np.cumsum(lengths) - lengths
        norms = np.stack([np.sqrt(np.add.reduceat((value * s[index]) ** 2, starts)) for s in scales])
        marks = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
        parts = [lengths, index, value, np.where(norms > 0, norms, 1.0), marks]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in parts], names=BLOCK)

    return rows.mapInArrow(pack, ", ".join(f"{name} binary" for name in BLOCK))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(lengths and starts of rows, indices, values, lengths of rows in each model, labels, marks) of each block, one at a time."""
    for i in range(batch.num_rows):
        lengths, index, value, norms, marks = (
            np.frombuffer(column[i].as_buffer(), kind) for column, kind in zip(batch.columns, (np.int32, np.int32, np.float64, np.float64, np.uint8))
        )
        marks = marks.reshape(len(lengths), -1)
        yield lengths, np.cumsum(lengths) - lengths, index.astype(np.intp), value, norms.reshape(-1, len(lengths)), marks[:, 0].astype(float), marks


# A row of counts, as bytes: how many entries lie in each segment of the places, the places within their segments, ascending, the counts (0 stands for
# one above 255, which ``more`` holds), and the length of the row in each model. An entry takes three bytes.
COUNTS = ("lengths", "places", "counts", "more", "norms")


def _bytes_of_rows(data: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """A binary value for each row; ``ends`` are the rows' ends in ``data``."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def packed_counts(row: np.ndarray, place: np.ndarray, count: np.ndarray, rows: int, scales: np.ndarray) -> pa.StructArray:
    """``COUNTS`` of rows 0 to ``rows`` - 1 from entries in the order of (row, place)."""
    segments = -(-scales.shape[1] // SEGMENT)
    lengths = np.bincount(row * segments + place // SEGMENT, minlength=rows * segments).astype(np.int32)
    ends = np.cumsum(lengths.reshape(rows, segments).sum(axis=1))
    large, value = count > 255, damping(count)
    norms = np.stack([np.sqrt(np.bincount(row, (value * s[place]) ** 2, rows)) for s in scales], axis=1)
    each = np.arange(1, rows + 1)
    columns = [
        _bytes_of_rows(lengths, each * segments),
        _bytes_of_rows((place % SEGMENT).astype(np.uint16), ends),
        _bytes_of_rows(np.where(large, 0, count).astype(np.uint8), ends),
        _bytes_of_rows(count[large].astype(np.int64), np.cumsum(np.bincount(row[large], minlength=rows))),
        _bytes_of_rows(np.where(norms > 0, norms, 1.0), each * norms.shape[1]),
    ]
    return pa.StructArray.from_arrays(columns, names=COUNTS)


def damping(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


_DAMPED = np.concatenate([[0.0], damping(np.arange(1, 256))])


def _values(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """The values of all rows of a column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _tiles(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``_blocks``, from rows (``COUNTS``, marks): runs of rows that are trained on by the same models, with about ``TILE_ENTRIES`` entries."""
    rows = batch.num_rows
    if not rows:
        return
    parts, marks = batch.column(0).flatten(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(rows, -1)
    pieces, places, counts, more, norms = (_values(x, kind) for x, kind in zip(parts, (np.int32, np.uint16, np.uint8, np.int64, np.float64)))
    pieces, norms = pieces.reshape(rows, -1), norms.reshape(rows, -1)
    lengths = pieces.sum(axis=1)
    ends, large = np.cumsum(lengths), np.cumsum(_sizes(parts[3])) // 8
    new = (np.diff(ends // TILE_ENTRIES, append=-1) != 0) | np.append((np.diff(marks[:, 1:], axis=0) != 0).any(axis=1), True)
    cuts = np.flatnonzero(new) + 1
    for start, end in zip([0, *cuts], cuts):
        here = slice(ends[start] - lengths[start], ends[end - 1])
        index, count = places[here].astype(np.intp), counts[here]
        if pieces.shape[1] > 1:
            index += np.repeat(np.tile(np.arange(pieces.shape[1]) * SEGMENT, end - start), pieces[start:end].ravel())
        value = np.take(_DAMPED, count.astype(np.intp))
        above = more[large[start - 1] if start else 0 : large[end - 1]]
        if len(above):
            value[count == 0] = damping(above)
        long = lengths[start:end]
        yield long, np.cumsum(long) - long, index, value, norms[start:end].T, marks[start:end, 0].astype(float), marks[start:end]


def _sizes(column: pa.BinaryArray) -> np.ndarray:
    return np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])


def _row_sums(values: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if lengths.all():
        return np.add.reduceat(values, starts)
    out, full = np.zeros(len(lengths)), np.flatnonzero(lengths)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def sparse_scores(batch: pa.RecordBatch, weights: Sequence[tuple[np.ndarray, float]]) -> np.ndarray:
    """For rows (``COUNTS``, marks): the score by each model whose mark is set, else NaN. The first mark counts for nothing."""
    out, at = np.full((batch.num_rows, len(weights)), np.nan), 0
    for lengths, starts, index, value, norms, _, marks in _tiles(batch):
        rows = slice(at, at := at + len(lengths))
        for m, (w, intercept) in enumerate(weights):
            if marks[0, 1 + m]:
                out[rows, m] = 0.5 * (1 + np.tanh((_row_sums(value * np.take(w, index), lengths, starts) / norms[m] + intercept) / 2))
    return out


def weights_of(models: Sequence[Linear], scales: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """What ``sparse_scores`` takes."""
    return [(np.array(model.coefficients) * scale, model.intercept) for model, scale in zip(models, scales)]


def marks_of(label: str, sides: Sequence[Column]) -> Column:
    """The label, and for each model whether it is trained on the row."""
    return F.transform(F.array(F.col(label), *sides), lambda x: F.coalesce(x, F.lit(False)).cast("tinyint"))


def fit_sparse(
    rows: DataFrame | Kept,
    scales: np.ndarray,
    vector: str = "damped",
    label: str = "need_strong",
    sides: Sequence[Column] | None = None,
    c: float = 1.0,
) -> list[Linear]:
    """One model for each of ``sides``, as ``fit_balanced``. The features of model m are the sparse ``vector`` times
    ``scales[m]``, at unit length. ``rows`` may be batches kept with ``vector`` as ``COUNTS``, made with the same scales, and ``marks``; the values
    are then 1 + ln(count).

    A pass gives objective and gradient of all models that are not done. The first step is solved by conjugate gradients, the others follow from the
    curvature that earlier steps have met (L-BFGS), so a pass is rarely needed for more than one of them."""
    many = len(scales)
    if isinstance(rows, Kept):
        numbers = rows.numbers(SparkSession.active())

        def passed(measure: Callable[[pa.RecordBatch], np.ndarray], columns: list[str], shape: tuple[int, ...]) -> np.ndarray:
            def run(files: pa.RecordBatch) -> np.ndarray:
                out = np.zeros(shape)
                for batch in rows.batches(files):
                    out += measure(batch.select([vector if c == "counts" else c for c in columns]))
                return out

            # Python objects of earlier passes hold their broadcasts in the driver's JVM.
            gc.collect()
            return summed(numbers, run, shape, SPARSE_DRIVER_BYTES)

        read, content = _tiles, ["counts", "marks"]
    else:
        marks = marks_of(label, [F.lit(True)] if sides is None else list(sides))
        parts = F.unwrap_udt(vector)
        rows = rows.select(parts["indices"].alias("indices"), parts["values"].alias("vals"), marks.alias("marks"))
        # Each task sends sums as wide as the models, so there are no more tasks than keep the cores busy.
        blocks = written(_packed_sparse(rows, scales), "blocks").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)

        def passed(measure: Callable[[pa.RecordBatch], np.ndarray], columns: list[str], shape: tuple[int, ...]) -> np.ndarray:
            return summed(blocks.select(columns), measure, shape, SPARSE_DRIVER_BYTES, SPARSE_BATCH_BYTES)

        read, content = _blocks, list(BLOCK)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        marks = batch.column(0)
        if pa.types.is_binary(marks.type):
            each = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in marks] or [np.zeros(0)])
        else:
            each = marks.flatten().to_numpy(zero_copy_only=False)
        each = each.reshape(-1, 1 + many).astype(float)
        return np.stack([each[:, 1:].sum(axis=0), each[:, 0] @ each[:, 1:]])

    n, p = passed(count, ["marks"], (2, many))
    if any(not 0 < b < a for a, b in zip(n, p)):
        raise ValueError("training rows need both classes")
    class_weights = np.array([[a / (2 * (a - b)), a / (2 * b)] for a, b in zip(n, p)])
    wide = scales.shape[1] + 1
    ridge = np.append(np.ones(wide - 1), 0.0)
    at = np.zeros((many, wide))

    def over(models: list[int], columns: list[np.ndarray], measure: Callable[..., None], width: int) -> np.ndarray:
        """``columns`` are vectors per model; ``measure`` gets the sums of each row with them, the first being its weights. It sees the
        values as they are, and what it adds up for a feature is to be scaled afterwards."""
        scaled = [(np.ascontiguousarray(c[:, :-1] * scales[models]), c[:, -1]) for c in columns]
        chosen = class_weights[models]

        def run(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(models), width))
            for lengths, starts, index, value, norms, y, marks in read(batch):
                for place, m in enumerate(models):
                    mine = marks[:, 1 + m] > 0
                    if not mine.any():
                        continue
                    weight = np.where(y > 0, chosen[place, 1], chosen[place, 0]) * mine
                    sums = [_row_sums(value * np.take(c[place], index), lengths, starts) / norms[m] + last[place] for c, last in scaled]
                    q = 0.5 * (1 + np.tanh(sums[0] / 2))
                    measure(out[place], lengths, index, value, norms[m], y, weight, sums, q)
            return out

        return passed(run, content, (len(models), width))

    def slopes(models: list[int], bent: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objective, gradient and, if ``bent``, the diagonal of the curvature."""

        def measure(out, lengths, index, value, norm, y, weight, sums, q):
            miss, bend = weight * (q - y), weight * q * (1 - q)
            out[0] += weight @ (np.logaddexp(0, sums[0]) - y * sums[0])
            out[1:wide] += np.bincount(index, value * np.repeat(miss / norm, lengths), wide - 1)
            out[wide] += miss.sum()
            if bent:
                out[wide + 1 : -1] += np.bincount(index, value * value * np.repeat(bend / norm**2, lengths), wide - 1)
                out[-1] += bend.sum()

        got = c * over(models, [at[models]], measure, 1 + (1 + bent) * wide)
        got[:, 1:wide] *= scales[models]
        got[:, wide + 1 : -1] *= scales[models] ** 2 if bent else 1
        value = got[:, 0] + 0.5 * ((at[models] * ridge) * at[models]).sum(axis=1)
        return value, got[:, 1 : 1 + wide] + at[models] * ridge, got[:, 1 + wide :] + (ridge if bent else 0)

    def curved(models: list[int], directions: np.ndarray) -> np.ndarray:
        def measure(out, lengths, index, value, norm, y, weight, sums, q):
            pull = weight * q * (1 - q) * sums[1]
            out[:-1] += np.bincount(index, value * np.repeat(pull / norm, lengths), wide - 1)
            out[-1] += pull.sum()

        got = c * over(models, [at[models], directions], measure, wide)
        got[:, :-1] *= scales[models]
        return got + directions * ridge

    keep = int(np.clip(STEP_BYTES // (8 * wide * many), FEWEST_STEPS, MOST_STEPS))
    # For each model the last steps, each with the change of the gradient along it, in turn over the same places.
    (paths, changes), products = np.zeros((2, many, keep, wide), dtype=np.float32), np.ones((many, keep))
    met = [0] * many

    def meet(m: int, step: np.ndarray, change: np.ndarray) -> None:
        if step @ change > 0:
            place = met[m] % keep
            paths[m, place], changes[m, place] = step, change
            products[m, place] = paths[m, place].astype(float) @ changes[m, place]
            met[m] += 1

    def against(m: int, gradient: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """The step against a gradient by the curvature met so far, and by a diagonal where none was."""
        rest, order, shares = -gradient, [i % keep for i in range(max(0, met[m] - keep), met[m])], {}
        for i in reversed(order):
            shares[i] = (paths[m, i] @ rest) / products[m, i]
            rest -= shares[i] * changes[m, i]
        rest /= diagonal
        for i in order:
            rest += (shares[i] - (changes[m, i] @ rest) / products[m, i]) * paths[m, i]
        return rest

    everyone = list(range(many))
    best, gradients, diagonals = slopes(everyone, True)
    first = np.linalg.norm(gradients, axis=1)
    rest, steps = -gradients, np.zeros_like(at)
    scaled = rest / diagonals
    directions, size = scaled.copy(), (rest * scaled).sum(axis=1)
    active = [m for m in everyone if first[m] > GRADIENT_TOLERANCE * max(first[m], 1.0)]
    for _ in range(FIRST_STEPS):
        going = [m for m in active if np.linalg.norm(rest[m]) > 0.1 * first[m]]
        if not going:
            break
        for m, product in zip(going, curved(going, directions[going])):
            meet(m, directions[m], product)
            length = size[m] / (directions[m] @ product)
            steps[m] += length * directions[m]
            rest[m] -= length * product
            scaled = rest[m] / diagonals[m]
            grown = rest[m] @ scaled
            directions[m] = scaled + grown / size[m] * directions[m]
            size[m] = grown
    base = at.copy()
    at = base + steps
    stretch = np.ones(many)
    for done in range(SPARSE_PASSES):
        if not active:
            return [Linear(tuple(w[:-1].tolist()), float(w[-1])) for w in at]
        models, bent = list(active), done % PASSES_PER_DIAGONAL == 0
        values, slope, bends = slopes(models, bent)
        for i, m in enumerate(models):
            if values[i] > best[m] + 1e-12 * abs(best[m]):  # too far: half the way
                steps[m] /= 2
                at[m] = base[m] + steps[m]
                continue
            change = slope[i] - gradients[m]
            meet(m, steps[m], change)
            if bent:
                diagonals[m] = bends[i]
            stretch[m] = max(1e-3, (steps[m] @ change) / (change @ (change / diagonals[m]))) if change.any() else 1.0
            base[m], best[m], gradients[m] = at[m].copy(), values[i], slope[i]
            if np.linalg.norm(slope[i]) <= GRADIENT_TOLERANCE * max(first[m], 1.0):
                active.remove(m)
                continue
            steps[m] = against(m, slope[i], diagonals[m] / stretch[m])
            at[m] = base[m] + steps[m]
    raise ValueError(f"no minimum after {SPARSE_PASSES} passes")
