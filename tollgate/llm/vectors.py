"""Integer vectors in numpy, and exact or floating sums of arrays over all tasks.

Only sums reach the driver: their size depends on parameters and the width of a vector, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a pass may send to the driver before the tasks' arrays are first added up on the executors.
DRIVER_BYTES = 16 << 20
LONG = pa.int64()


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of a matrix; shorter ones end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(length) and (length == width).all():
        return values.reshape(len(length), width).astype(np.int64, copy=False)
    out = np.zeros((len(length), width), dtype=np.int64)
    out[np.arange(width) < length[:, None]] = values
    return out


def magnitude(values: np.ndarray) -> int:
    return max(-int(values.min()), int(values.max()), 0) if values.size else 0


def fitting(values: list) -> pa.Array:
    """Whole numbers as longs; null where one does not fit."""
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], LONG)


def exact_totals(df: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray], size: int) -> list[int]:
    """The sum, place by place, of the ``size`` whole numbers that ``measure`` finds in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=object)
        for batch in batches:
            total += measure(batch).astype(object)
        at = np.flatnonzero(total != 0)
        values = pa.array([Decimal(int(v)) for v in total[at]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(at, LONG), values], names=["at", "total"])

    out = [0] * size
    for at, total in df.mapInArrow(run, "at long, total decimal(38,0)").groupBy("at").agg(F.sum("total")).collect():
        out[at] = int(total)
    return out


def summed(df: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], driver_bytes: int = DRIVER_BYTES) -> np.ndarray:
    """The sum of the float arrays that ``measure`` finds in each batch. Arrays of the tasks are added in the order of
    the tasks; while they are more than ``driver_bytes``, groups of them are added up on the executors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += measure(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], LONG), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("task").to_pylist(), table.column("total").to_pylist(), strict=True))
        total = np.sum([np.frombuffer(x) for _, x in rows], axis=0)
        return pa.table({"task": pa.array([rows[0][0]], LONG), "total": pa.array([total.tobytes()], pa.binary())})

    arrays, count = df.mapInArrow(run, "task long, total binary"), df.rdd.getNumPartitions()
    while count > 4 and count * 8 * int(np.prod(shape)) > driver_bytes:
        count = -(-count // 8)
        arrays = arrays.groupBy(F.pmod("task", F.lit(count))).applyInArrow(add, "task long, total binary")
    total = np.zeros(shape)
    for _, data in sorted(arrays.collect()):
        total += np.frombuffer(data).reshape(shape)
    return total
