"""Texts of an Arrow batch as one byte array, and words, windows and hashes over it in numpy.

Nothing here loops over words in Python; every function works on all texts of a chunk at once.
A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
# White space of the word pattern, odd multipliers of the hashes.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

GAP = np.zeros(256, dtype=bool)
GAP[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that equal parts of the range hold equal shares."""
    x = x ^ (x >> U64(30))
    x = x * U64(MIX[0])
    x ^= x >> U64(27)
    x *= U64(MIX[1])
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class PowerTable:
    """Powers of a base and of its inverse, grown as needed and kept by the Python worker."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def shrink(self, n: int = 1 << 18) -> None:
        if len(self.up) > n:
            self.up, self.down = self.up[:n].copy(), self.down[:n].copy()

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // (1 << 18)) << 18
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        return self.up[:n], self.down[:n]


TABLES = tuple(PowerTable(b) for b in BASES)


def prefix_hashes(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of values[k] * base ** k for i <= k < j."""
    up, _ = TABLES[which].get(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of values[begin:end] for each span, the same wherever the span stands."""
    _, down = TABLES[which].get(len(prefix))
    length = (end - begin).astype(np.uint64)
    return mixed((prefix[end] - prefix[begin]) * down[begin] + length * U64(MIX[which]))


def window_hashes(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all windows of ``size`` values; windows across texts are for the caller to leave out."""
    if len(values) < size:
        return np.zeros(0, dtype=np.uint64)
    begin = np.arange(len(values) - size + 1)
    return span_hashes(prefix_hashes(values, which), begin, begin + size, which)


class Texts:
    """The bytes of some texts and, as slices of it, their words."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "") if column.null_count else column
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, places, data = column.buffers()
        bounds = np.frombuffer(places, dtype=np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
        bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self.n = len(column)

    def find_words(self, cuts: np.ndarray | None = None) -> None:
        """Sets begin and end (bytes of each word) and words (first word of each text, and the total).
        ``cuts`` tells of places at which words are cut further; place i lies before byte i."""
        gap = GAP[self.data]
        edge = np.zeros(len(gap) + 1, dtype=bool) if cuts is None else cuts
        edge[self.bounds] = True
        before, after = np.ones_like(gap), np.ones_like(gap)
        if len(gap):
            before[1:] = gap[:-1] | edge[1:-1]
            after[:-1] = gap[1:] | edge[1:-1]
        self.begin = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.words = np.searchsorted(self.begin, self.bounds)

    def word_hashes(self, lower: bool = False, which: int = 0) -> np.ndarray:
        values = (LOWER[self.data] if lower else self.data).astype(np.uint64) + U64(1)
        return span_hashes(prefix_hashes(values, which), self.begin, self.end, which)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.words))

    def per_text(self, word_values: np.ndarray) -> np.ndarray:
        """Sums of a value per word, for each text."""
        sums = np.zeros(len(word_values) + 1, dtype=np.int64)
        np.cumsum(word_values, out=sums[1:])
        return sums[self.words[1:]] - sums[self.words[:-1]]

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text joined by one space: bytes, and bounds of the texts."""
        data, taken = self.data.copy(), np.zeros(len(self.data) + 1, dtype=np.int8)
        begin, end = self.begin[keep], self.end[keep]
        np.add.at(taken, begin, 1)
        np.add.at(taken, end, -1)
        mask = np.cumsum(taken[:-1], dtype=np.int8).astype(bool)
        owner = self.text_of_words()[keep]
        joint = end[:-1][owner[1:] == owner[:-1]]
        data[joint] = 0x20
        mask[joint] = True
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return data[mask], sums[self.bounds]


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    change = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with at most ``limit`` bytes of text, or one text. At the end memory that is not used goes back."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            part = batch.slice(at, stop - at)
            yield part, Texts(part.column(batch.schema.get_field_index(text)))
            at = stop
    release()


def release() -> None:
    """Give memory that this worker does not use any more back to the machine: idle workers wait for the next stage."""
    for table in TABLES:
        table.shrink()
    pa.default_memory_pool().release_unused()


def table_chunks(table: pa.Table, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The same for a table, whose rows come in order."""
    return chunks(iter(table.combine_chunks().to_batches()), text, limit)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each span, one after the other."""
    total = int(length.sum())
    starts = np.cumsum(length) - length
    return np.repeat(begin - starts, length) + np.arange(total)
