"""Sums of numpy arrays over all tasks of a pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tollgate.functions.memory import steady_heap
from tollgate.session import batches_of

# What a pass may send to the driver before the tasks' arrays are first added up on the executors.
DRIVER_BYTES = 16 << 20
TOTALS = "task long, total binary"


def _rows(task: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([task], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "total"]
    )


def summed(
    df: DataFrame,
    measure: Callable[[pa.RecordBatch], np.ndarray],
    shape: tuple[int, ...],
    driver_bytes: int = DRIVER_BYTES,
    batch_bytes: int | None = None,
) -> np.ndarray:
    """The sum of the float arrays that ``measure`` finds in each batch. Arrays of the tasks are
    added in the order of the tasks; while they are more than ``driver_bytes``, groups of
    eight are added up on the executors first. ``batch_bytes`` bounds a batch below the session's setting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        total = np.zeros(shape)
        for batch in batches:
            total += measure(batch)
        yield _rows(TaskContext.get().partitionId(), total)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("task").to_pylist(), table.column("total").to_pylist()))
        total = np.sum([np.frombuffer(x) for _, x in rows], axis=0)
        return pa.Table.from_batches([_rows(rows[0][0], total)])

    arrays, count = df.mapInArrow(run, TOTALS), df.rdd.getNumPartitions()
    while count > 4 and count * 8 * int(np.prod(shape)) > driver_bytes:
        count = -(-count // 8)
        arrays = arrays.groupBy(F.pmod("task", F.lit(count))).applyInArrow(add, TOTALS)
    total = np.zeros(shape)
    with batches_of(df.sparkSession, batch_bytes) if batch_bytes else nullcontext():
        rows = arrays.collect()
    for _, data in sorted(rows):
        total += np.frombuffer(data).reshape(shape)
    return total
