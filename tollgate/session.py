"""Shared folder, files in it, and size-checked small tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# The engine gives what it has no figure for a size of about 2^63.
UNKNOWN_BYTES = 1 << 60


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: what the cluster names in
    ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary one, removed at exit."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tollgate-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/tollgate-{spark.sparkContext.applicationId}"


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the intermediate tables that are made inside; the caller may ``remove`` it
    as soon as what was computed from them has been stored."""
    folder = f"{own_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    try:
        yield folder
    finally:
        _SCRATCH.remove(folder)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It stays until ``clean`` or ``remove``, since results may be read at any time."""
    return f"{_SCRATCH[-1] if _SCRATCH else own_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Tables of the catalog whose files lie in the shared folder, by name.
_TABLES: dict[str, str] = {}


def note_table(name: str, path: str) -> None:
    """A table of the catalog that is to go when its folder is removed."""
    _TABLES[name] = path


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, and the tables of the catalog that lie in it."""
    for name in [n for n, path in _TABLES.items() if f"{path}/".startswith(f"{folder.rstrip('/')}/")]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        del _TABLES[name]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return [f.getPath().getName() for f in system.listStatus(path) if f.isDirectory()]


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """How a task reaches a shared folder, and the folder's path there."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results have been stored elsewhere."""
    remove(spark, own_folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that work
    which must not run twice (model calls, fitted scores) survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> DataFrame:
    """Store an aggregated table so that its true size is known to the optimizer, which then
    broadcasts it below ``autoBroadcastJoinThreshold`` and shuffles it otherwise. It is neither
    computed twice nor held in memory, and plans over it stay short."""
    return written(df, "small")


def spread(df: DataFrame, n: int, rows_per_core: int = 10_000) -> DataFrame:
    """Deal out a small table of n rows before costly per-row work, which would else run in
    the one or two tasks such a table comes in. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if n < cores * rows_per_core else df


def known_bytes(df: DataFrame) -> int | None:
    """What the files that ``df`` reads take; None for a stream, or if it also reads something whose size is not known."""
    if df.isStreaming:
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < UNKNOWN_BYTES else None


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Python tasks of the queries that run inside get batches of about ``size`` bytes; each task holds several of them, here and on the JVM."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)
