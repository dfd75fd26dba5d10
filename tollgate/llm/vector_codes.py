"""Compression of vectors to one byte a part: product quantisation, with codebooks trained by exact ball k-means.

A vector is floor(scale * x), cut into equal parts. Each part position has a codebook, which begins as that part of the vectors with the
smallest ids. A round assigns every part to its nearest entry and moves the entries to their parts' mean, rounded down.

Assignment starts from the code a part has (in the first round from the best of a few entries) and uses balls. An entry with the parts that
have its code is a ball; its radius, the largest distance of its parts, defines its neighbours: only entries within twice the radius can
take a part from it. A ball that did not move, and whose neighbours did not, is left as it is. A part whose own distance is below half the way
to the nearest neighbour lies in the stable core. Beyond it, the distances to the neighbours in order, halved, bound rings: a
part in the m-th ring is compared with the m nearest neighbours only. All of it is done in squares of whole numbers, so it is
exact, and equal distances go to the lower index.

Rows keep their codes in a table between rounds, and the sums of parts by entry are added up per task first. The driver holds the codebooks.

Defined cases: a vector that is null or holds null or non-finite components is dropped. Vectors shorter than the longest, and a
width that the number of parts does not divide, are filled up with zeros. Repeated ids and rows stay; null ids come last, equal ids in order of
their vectors. With fewer vectors than entries, codebooks are smaller. 64-bit limits hold components beyond
them; an error that does not fit into a long is null. Other columns are not read but for the label, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.topk import scaled
from tollgate.llm.vectors import LONG, exact_totals, fitting, magnitude, matrix
from tollgate.session import written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: In the first round every so many-th entry is tried for a start, then as many entries next to the best.
FIRST_STEP = 8
NAMES = ["vec_id", "label", "vector", "codes"]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    off = a - b
    return (off * off).sum(axis=-1)


class Codebooks:
    """``entries[p, k]`` is entry k of part position p; ``still[p, k]`` tells whether it stayed where it was."""

    def __init__(self, entries: np.ndarray, still: np.ndarray | None = None):
        self.entries = entries
        self.parts, self.size, self.width = entries.shape
        self.still = np.zeros((self.parts, self.size), dtype=bool) if still is None else still
        self.largest = magnitude(entries)

    def arrange(self, entries: np.ndarray) -> None:
        """For each entry, the others by distance: their numbers, and the squared distances."""
        apart = distances(entries[:, :, None], entries[:, None])
        own = np.arange(self.size)
        apart[:, own, own] = -1
        self.order = np.argsort(apart, axis=2, kind="stable")[:, :, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=2)

    def assign(self, vectors: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each part and its squared distance, and how many distances were taken."""
        n, entries = len(vectors), self.entries
        most = 2 * max(magnitude(vectors), self.largest)
        if 4 * most * most * self.width * self.parts >= 1 << 62:  # too large for 64 bits
            vectors, entries = vectors.astype(object), entries.astype(object)
        self.arrange(entries)
        points = vectors.reshape(n * self.parts, self.width)
        part = np.tile(np.arange(self.parts), n)
        taken = len(points)
        if codes is None:
            start = np.zeros(len(points), dtype=np.int64)
            own = distances(points, entries[part, start])
            for k in range(FIRST_STEP, self.size, FIRST_STEP):
                d = distances(points, entries[part, k])
                start, own = np.where(d < own, k, start), np.where(d < own, d, own)
                taken += len(points)
            first = start
            for ring in range(min(FIRST_STEP, self.size - 1)):
                at = self.order[part, first, ring]
                d = distances(points, entries[part, at])
                start, own = np.where(d < own, at, start), np.where(d < own, d, own)
                taken += len(points)
        else:
            start = codes.reshape(-1).astype(np.int64)
            own = distances(points, entries[part, start])
        ball = part * self.size + start
        best, best_at = own.copy(), start.copy()
        left = np.flatnonzero(~self.left_alone(ball, own)[ball]) if codes is not None else np.arange(len(points))
        for ring in range(self.size - 1):
            left = left[self.apart[part[left], start[left], ring] <= 4 * own[left]]
            if not len(left):
                break
            at = self.order[part[left], start[left], ring]
            d = distances(points[left], entries[part[left], at])
            nearer = (d < best[left]) | ((d == best[left]) & (at < best_at[left]))
            best[left[nearer]], best_at[left[nearer]] = d[nearer], at[nearer]
            taken += len(left)
        return best_at.reshape(n, self.parts).astype(np.uint8), best.reshape(n, self.parts), taken

    def left_alone(self, ball: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Balls that stayed where they were, with all neighbours: no part of theirs can have changed sides."""
        n_balls = self.parts * self.size
        radius = np.zeros(n_balls, dtype=own.dtype)
        np.maximum.at(radius, ball, own)
        apart, order = (x.reshape(n_balls, self.size - 1) for x in (self.apart, self.order))
        neighbours = apart <= 4 * radius[:, None]
        still = self.still[np.arange(n_balls)[:, None] // self.size, order.astype(np.int64)]
        return self.still.reshape(-1) & (still | ~neighbours).all(axis=1)

    def sums(self, vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of each entry, the sums of its parts' components and their number, as one row."""
        n = len(vectors)
        place = (np.arange(self.parts) * self.size + codes).reshape(-1)
        points = vectors.reshape(n * self.parts, self.width)
        out = np.zeros((self.parts * self.size, self.width + 1), dtype=object)
        out[:, -1] = np.bincount(place, minlength=len(out))
        if magnitude(vectors) * n < 1 << 52:  # sums in doubles are exact
            for j in range(self.width):
                out[:, j] = np.bincount(place, weights=points[:, j], minlength=len(out)).astype(np.int64)
        else:
            np.add.at(out[:, :-1], place, points.astype(object))
        return out.reshape(-1)

    def moved(self, totals: list[int]) -> Codebooks:
        """Each entry at the mean of its parts, rounded down; unused ones stay."""
        rows = np.array(totals, dtype=object).reshape(self.parts, self.size, self.width + 1)
        used = rows[..., -1] > 0
        means = rows[..., :-1] // np.where(used, rows[..., -1], 1)[..., None]
        entries = np.where(used[..., None], means, self.entries.astype(object)).astype(np.int64)
        return Codebooks(entries, (entries == self.entries).all(axis=2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.entries[np.arange(self.parts), codes].reshape(len(codes), -1)


def read_codes(column: pa.Array, parts: int) -> np.ndarray | None:
    if column.null_count:
        return None
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts)


def first_codebooks(rows: DataFrame, parts: int, width: int, entries: int) -> Codebooks:
    """From the vectors with the smallest ids; of each task at most ``entries`` rows are looked at further."""
    seeds = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    values = np.zeros((len(seeds), parts * width), dtype=np.int64)
    for i, row in enumerate(seeds):
        values[i, : len(row["vector"])] = row["vector"]
    return Codebooks(np.ascontiguousarray(values.reshape(len(seeds), parts, width).transpose(1, 0, 2)))


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with new codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("vector"), books.parts * books.width)
                codes, _, _ = books.assign(vectors.reshape(-1, books.parts, books.width), read_codes(batch.column("codes"), books.parts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary())], names=NAMES)

    return rows.mapInArrow(run, rows.schema)


def train(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
) -> tuple[DataFrame, Codebooks | None]:
    """The rows that take part, as a table (vec_id, label, vector, codes) with the codes of the last round, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), scaled(F.col(vector_col), scale).alias("vector"))
    rows = written(rows.where("vector is not null").withColumn("codes", F.lit(None).cast("binary")), "vectors")
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return rows, None
    width = max(1, -(-longest // parts))
    books = first_codebooks(rows, parts, width, entries)
    for _ in range(rounds):
        rows = written(assigned(rows, books), "codes")

        def sums(batch: pa.RecordBatch, books: Codebooks = books) -> np.ndarray:
            values = matrix(batch.column("vector"), books.parts * books.width)
            return books.sums(values.reshape(-1, books.parts, books.width), read_codes(batch.column("codes"), books.parts))

        books = books.moved(exact_totals(rows.select("vector", "codes"), sums, books.parts * books.size * (books.width + 1)))
    return rows, books


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """(vec_id, label, code, error) of trained rows, with codes by the final codebooks."""
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("vector"), books.parts * books.width)
                codes, away, _ = books.assign(vectors.reshape(-1, books.parts, books.width), read_codes(batch.column("codes"), books.parts))
                total = away.sum(axis=1)
                errors = fitting(total.tolist()) if total.dtype == object else pa.array(total, LONG)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes().hex() for c in codes], pa.string()), errors], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def compress(vectors: DataFrame, label_col: str | None = "label", **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256). ``label_error`` is the sum of the errors of a label's rows, null where it
    does not fit into a long or one of them does not; null labels are one label."""
    rows, books = train(vectors, label_col=label_col, **options)
    coded = written(encode(rows, books), "coded")
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    by_label = coded.groupBy("label").agg(total.try_cast("long").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "of_label")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
