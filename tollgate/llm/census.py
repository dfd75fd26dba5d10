"""How often the keys of a corpus occur, told to the part of the corpus that asked.

A corpus is staged once: cut into parts of bounded size and written to the shared folder as a table bucketed by part. Every
later pass groups by part without moving a text. A pass lists the distinct keys of each part in ascending
order, packed and cut at fixed places of the key range into slices. A slice gathers the lists of all parts, adds
up their counts, and answers each list with the count of each key. So nothing is collected or
broadcast, a key moves in a few bytes and once for each part at most, however often it occurs there, and the
answers line up with the lists when a part computes them again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.session import new_path, note_table

PART_BYTES = 8 << 20
SLICE_KEYS = 1_000_000
MAX_BUCKETS = 100_000
PART = "part long"
LISTS = "slice long, part long, n long, keys binary, extra binary, counts binary"
FLAGS = "part long, slice long, n long, flags binary"


class Stage:
    """A corpus in parts: ``docs`` has part, doc_id and text. ``n_bytes`` is the length of all texts."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES):
        spark = docs.sparkSession
        name, path = f"parts_{uuid.uuid4().hex}", new_path(spark, "parts")
        # A file per bucket and task at least is written now and by each pass, so not more buckets than tasks are needed.
        buckets = min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Consecutive rows of a task share a part of ``part_bytes`` or one text."""
            first, held = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                upto = held + np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
                held = int(upto[-1]) if len(upto) else held
                yield pa.RecordBatch.from_arrays([pa.array(first + upto // part_bytes), *batch.columns], names=["part", "doc_id", "text"])

        parts = rows.mapInArrow(number, f"{PART}, doc_id long, text string")
        parts.write.bucketBy(buckets, "part").option("path", path).format("parquet").saveAsTable(name)
        note_table(name, path)
        self.docs = spark.table(name)
        self.n_bytes = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def slices(self, bytes_per_key: float) -> int:
        return max(1, math.ceil(self.n_bytes / bytes_per_key / SLICE_KEYS))


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values: differences, written byte plane by byte plane, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u4").tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<u4")


class Keys:
    """Distinct keys of a part: ascending 64-bit values, with 32 more bits if wanted, and how often they occur there."""

    def __init__(self, values: np.ndarray, extra: np.ndarray | None = None):
        order = np.argsort(values, kind="stable") if extra is None else np.lexsort((extra, values))
        values, extra = values[order], None if extra is None else extra[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = values[1:] != values[:-1]
        if extra is not None:
            new[1:] |= extra[1:] != extra[:-1]
        number = np.cumsum(new) - 1
        self.which = np.empty(len(values), dtype=np.int64)
        self.which[order] = number
        self.values, self.extra = values[new], None if extra is None else extra[new]
        self.counts = np.bincount(number, minlength=len(self.values))

    def lists(self, part: int, slices: int, first: int = 0) -> Iterator[tuple]:
        """Rows of LISTS; slices are equal ranges of the values, numbered from ``first``."""
        width = -(-(1 << 64) // slices)
        cuts = np.searchsorted(self.values, np.array([i * width for i in range(1, slices)], dtype=np.uint64))
        for number, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.values)], strict=True)):
            if b > a:
                extra = b"" if self.extra is None else self.extra[a:b].astype("<u4").tobytes()
                yield first + number, part, b - a, pack(self.values[a:b]), extra, pack_counts(self.counts[a:b])


def rows_table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def list_table(rows: list[tuple]) -> pa.Table:
    return rows_table(rows, ["slice", "part", "n", "keys", "extra", "counts"], [pa.int64()] * 3 + [pa.binary()] * 3)


def _merge(table: pa.Table) -> pa.Table:
    """Answers to all lists of a slice: the count of each key."""
    sizes = table.column("n").to_numpy()
    values = np.concatenate([unpack(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    extra = b"".join(table.column("extra").to_pylist())
    keys = Keys(values, np.frombuffer(extra, "<u4") if extra else None)
    total = np.minimum(np.bincount(keys.which, weights=counts), 0xFFFFFFFF).astype(np.uint32)
    flags = np.split(total[keys.which], np.cumsum(sizes)[:-1])
    rows = [(p, s, int(n), pack_counts(f)) for p, s, n, f in zip(table.column("part").to_pylist(), table.column("slice").to_pylist(), sizes, flags, strict=True)]
    return rows_table(rows, ["part", "slice", "n", "flags"], [pa.int64()] * 3 + [pa.binary()])


def answered(lists: DataFrame) -> DataFrame:
    """FLAGS for LISTS."""
    return lists.groupBy("slice").applyInArrow(_merge, FLAGS)


def counts(flags: pa.Table, low: int = 0, high: int = 1 << 62) -> np.ndarray:
    """The answers to one set of keys, whose slices lie in [low, high), in the order of the keys."""
    rows = zip(flags.column("slice").to_pylist(), flags.column("flags").to_pylist(), strict=True)
    mine = sorted(x for x in rows if low <= x[0] < high)
    return np.concatenate([np.zeros(0, dtype=np.uint32), *(unpack_counts(f) for _, f in mine)])


def per_part(docs: DataFrame, flags: DataFrame | None, run: Callable[[int, pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """``run`` on each part's texts, with the answers to that part if there are any."""
    if flags is None:
        return docs.groupBy("part").applyInArrow(lambda table: run(table.column("part")[0].as_py(), table, None), schema)

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key[0].as_py(), left, right)

    return docs.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(both, schema)
