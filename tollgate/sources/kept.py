"""Arrow batches kept in files of the shared folder, one for each task that made them. Passes read them in Python, without the JVM in between."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tollgate.session import file_system, new_path


@dataclass(frozen=True)
class Kept:
    paths: tuple[str, ...]

    def numbers(self, spark: SparkSession) -> DataFrame:
        """A row for each file, dealt out to the cores."""
        n = len(self.paths)
        return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism)))

    def batches(self, numbers: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """What the files of some of these rows hold, a batch at a time."""
        for i in numbers.column(0).to_pylist():
            system, path = file_system(self.paths[i])
            with system.open_input_stream(path) as file, pa.ipc.open_stream(file) as found:
                yield from found


def keep(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str) -> Kept:
    """Keep the batches that ``make`` finds in each task. An attempt has a file of its own, and only files of tasks that succeeded are known."""
    folder = new_path(df.sparkSession, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, found = f"{folder}/{uuid.uuid4().hex}.arrow", make(batches)
        first = next(found, None)
        if first is None:
            return
        system, place = file_system(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(place) as file, pa.ipc.new_stream(file, first.schema) as out:
            out.write_batch(first)
            for batch in found:
                out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return Kept(tuple(sorted(r["path"] for r in df.mapInArrow(write, "path string").collect())))
