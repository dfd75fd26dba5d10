"""Paid calls whose replies outlive the job.

The questions are dealt into slices by a hash of their id, one for each task; with many questions slices grow, not their number.
A task commits every few replies as a file of their own in the shared folder: written under a hidden name, then renamed. After
``MERGE_ROWS`` replies one file with all of them takes the place of the small ones, which go only when it can be read, so a
reader may see a reply twice but never misses one. A task that is tried again reads what its slice has committed and asks only the
rest, and so does a later run after the driver was lost.

Before each call a task looks for the stop mark in the folder. The one whose answer function gives up writes it, so all
partitions stop, also those that have not begun. Two attempts of one task at a time would both pay, so speculative
execution should be off for such a job.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.session import file_system, folders, written

RAW = "id bigint, model string, raw string, seconds double, at double"
OUTCOME = "slice bigint, answered bigint, failed bigint, stopped boolean"
STOP = "_STOP"  # not a data file to readers
ROWS_PER_SLICE = 200  # more where that makes over MAX_SLICES, and over SLICES_PER_CORE for each core
MAX_SLICES = 1_000
SLICES_PER_CORE = 32
COMMIT_ROWS = 20
MERGE_ROWS = 1_000  # held by a task until they lie in one file
BATCH_ROWS = 200
COMMIT_SECONDS = 10.0
_ARROW = pa.schema([("id", pa.int64()), ("model", pa.string()), ("raw", pa.string()), ("seconds", pa.float64()), ("at", pa.float64())])
_OUTCOME = pa.schema([("slice", pa.int64()), ("answered", pa.int64()), ("failed", pa.int64()), ("stopped", pa.bool_())])


class StopCalls(Exception):
    """Raised by an answer function when further calls are pointless (no credit left)."""

    # Looked up by name: a worker may hold its own copy of this class.
    stops_calls = True


class StopMark:
    """A file that tells all tasks of a run to make no more calls."""

    def __init__(self, folder: str):
        self.system, path = file_system(folder)
        self.path = f"{path}/{STOP}"

    def is_set(self) -> bool:
        return self.system.get_file_info(self.path).type != fs.FileType.NotFound

    def set(self, why: str) -> None:
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(self.path) as out:
            out.write(why.encode())


class SliceFiles:
    """The committed replies of one slice."""

    def __init__(self, folder: str, number: int, commit_rows: int, commit_seconds: float):
        self.system, path = file_system(folder)
        self.path = f"{path}/slice={number}"
        self.commit_rows, self.commit_seconds = commit_rows, commit_seconds
        self.waiting: list[tuple] = []
        self.small: list[str] = []  # files committed since the last merge, and their rows
        self.held: list[tuple] = []
        self.since = time.monotonic()

    def asked(self) -> set[int]:
        chosen = fs.FileSelector(self.path, allow_not_found=True)
        files = [f.path for f in self.system.get_file_info(chosen) if f.is_file and not f.base_name.startswith((".", "_"))]
        return {i for f in files for i in pq.read_table(f, columns=["id"], filesystem=self.system, partitioning=None).column("id").to_pylist()}

    def add(self, row: tuple) -> None:
        self.waiting.append(row)
        if len(self.waiting) >= self.commit_rows or time.monotonic() - self.since >= self.commit_seconds:
            self.commit()

    def commit(self) -> None:
        if len(self.held) + len(self.waiting) >= MERGE_ROWS:
            self.merge()
        elif self.waiting:
            self.small.append(self.write(self.waiting))
            self.held += self.waiting
        self.waiting, self.since = [], time.monotonic()

    def close(self) -> None:
        """Commit the last replies; the slice needs no small files any more."""
        if len(self.small) + bool(self.waiting) > 1:
            self.merge()
            self.waiting = []
        self.commit()

    def merge(self) -> None:
        """One file for all replies since the last one, in place of the small files."""
        self.write(self.held + self.waiting)
        for path in self.small:
            self.system.delete_file(path)
        self.small, self.held = [], []

    def write(self, rows: list[tuple]) -> str:
        name = f"{uuid.uuid4().hex}.parquet"
        self.system.create_dir(self.path, recursive=True)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)]
        pq.write_table(pa.Table.from_arrays(columns, schema=_ARROW), f"{self.path}/.{name}", filesystem=self.system)
        self.system.move(f"{self.path}/.{name}", f"{self.path}/{name}")
        return f"{self.path}/{name}"


def call(answer: Callable[[str], str], prompt: str, attempts: int, wait_seconds: float) -> tuple[str | None, str | None, bool]:
    """(reply, error, stop). A failed call is tried again after a growing wait; one that was refused for good is not."""
    for attempt in range(1, attempts + 1):
        try:
            return answer(prompt), None, False
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if getattr(e, "stops_calls", False):
                return None, error, True
            if attempt < attempts:
                time.sleep(wait_seconds * attempt)
    return None, error, False


def ask_durably(
    todo: DataFrame,
    make_answer: Callable[[], Callable[[str], str]],
    model: str,
    folder: str,
    attempts: int = 3,
    wait_seconds: float = 5.0,
    rows_per_slice: int = ROWS_PER_SLICE,
    commit_rows: int = COMMIT_ROWS,
    commit_seconds: float = COMMIT_SECONDS,
) -> DataFrame:
    """Ask a model for each (id, prompt) and commit the replies to ``folder``, as RAW; gives OUTCOME by slice. ``make_answer``
    runs once per partition and returns the function that maps a prompt to a reply. Failed calls are counted, not stored."""
    todo = written(todo.select("id", "prompt"), "todo")  # slices must not change while replies are paid for
    most = max(MAX_SLICES, SLICES_PER_CORE * todo.sparkSession.sparkContext.defaultParallelism)
    slices = max(1, min(most, -(-todo.count() // rows_per_slice)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, mark, outcomes, files, done, stopped = None, StopMark(folder), {}, None, set(), False
        pieces = (batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))
        for piece in pieces:
            for number, key, prompt in zip(*(c.to_pylist() for c in piece.columns)):
                if number not in outcomes:
                    if files:
                        files.close()
                    outcomes[number] = [0, 0]
                    files = SliceFiles(folder, number, commit_rows, commit_seconds)
                    done = files.asked()
                stopped = stopped or mark.is_set()
                if stopped or key in done:
                    continue
                answer = answer or make_answer()
                started = time.perf_counter()
                raw, error, stopped = call(answer, prompt, attempts, wait_seconds)
                if stopped:
                    mark.set(error)
                elif error is not None:
                    outcomes[number][1] += 1
                else:
                    outcomes[number][0] += 1
                    files.add((key, model, raw, round(time.perf_counter() - started, 2), time.time()))
        if files:
            files.close()
        rows = [(n, *counts, stopped) for n, counts in outcomes.items()]
        columns = list(zip(*rows)) if rows else [[] for _ in _OUTCOME]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUTCOME)], schema=_OUTCOME)

    number = F.spark_partition_id().cast("long").alias("slice")  # a function of the id, and the same when a task is tried again
    dealt = todo.repartition(slices, "id").select(number, "id", "prompt").sortWithinPartitions("id")
    return dealt.mapInArrow(ask, OUTCOME)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """All committed replies of the runs below ``folder``, the earliest of each (id, model)."""
    paths = [f"{folder}/{run}" for run in folders(spark, folder)]
    paths = [p for p in paths if folders(spark, p)]
    if not paths:
        return spark.createDataFrame([], RAW)
    rows = spark.read.schema(RAW).option("recursiveFileLookup", True).parquet(*paths)
    first = F.min_by(F.struct("raw", "seconds", "at"), "at").alias("r")
    return rows.groupBy("id", "model").agg(first).select("id", "model", "r.*")
