"""Remove repeated passages of 35 words, with a count-min prefilter.

Every part of the corpus makes a count-min sketch of its windows: for each of ``ROWS`` hash rows the cells that are hit, with
counts up to two. The sketches are merged cell by cell. A window is estimated to repeat if its cell counts two
or more in every row; cells can only count too much, so no repeated window is missed. A second pass
groups exactly, by 96 bits, the windows that are estimated to repeat, and drops what the estimate had too much. The rows' width grows with
the corpus, so the share of windows that pass by chance does not.

Windows stay within a document and are judged on the input. Null text: no words, the digest of the empty string. Repeated
rows and ids keep a row each and count as further occurrences. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tollgate.llm import census
from tollgate.llm.words import Texts, covered, mixed, prefix_hashes, span_hashes, table_chunks
from tollgate.session import written

WINDOW = 35
ROWS = 2
CELLS_PER_BYTE = 2  # width of a row; about one window in seven bytes, so a few percent of the cells are hit
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"
U64 = np.uint64


class Windows:
    """The windows of a part: two 64-bit hashes of each, in order, and by chunk the texts and each window's first word."""

    def __init__(self, table: pa.Table, size: int):
        self.chunks: list[tuple[Texts, np.ndarray]] = []
        hashes: list[list[np.ndarray]] = [[], []]
        for _, texts in table_chunks(table):
            texts.find_words()
            owner = texts.text_of_words()
            at = np.arange(len(owner))
            begin = at[at + size <= texts.words[1:][owner]]
            for which in (0, 1):
                prefix = prefix_hashes(texts.word_hashes(which=which), which)
                hashes[which].append(span_hashes(prefix, begin, begin + size, which))
            self.chunks.append((texts, begin))
        self.hashes = [np.concatenate(x) for x in hashes]


def cells(windows: Windows, row: int, width_bits: int) -> census.Keys:
    """The cells of one sketch row that the windows hit, as keys whose leading bits number the cell."""
    mixed_ = mixed(windows.hashes[0] + windows.hashes[1] * U64(2 * row + 1) + U64(row))
    return census.Keys(mixed_ >> U64(64 - width_bits) << U64(64 - width_bits))


def estimated(windows: Windows, flags: pa.Table, rows: int, width_bits: int, slices: int) -> np.ndarray:
    """Which windows every sketch row counts twice or more."""
    out = np.ones(len(windows.hashes[0]), dtype=bool)
    for row in range(rows):
        keys = cells(windows, row, width_bits)
        out &= census.counts(flags, row * slices, (row + 1) * slices)[keys.which] >= 2
    return out


def exact_keys(windows: Windows, maybe: np.ndarray) -> census.Keys:
    return census.Keys(windows.hashes[0][maybe], (windows.hashes[1][maybe] >> U64(32)).astype(np.uint32))


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = census.PART_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and n_spans (runs of removed words); with ``with_text`` also the
    kept words, joined by one space, as ``kept``."""
    stage = census.Stage(docs, id_col, text_col, part_bytes)
    width_bits = min(63, max(16, (CELLS_PER_BYTE * stage.n_bytes).bit_length()))
    slices = stage.slices(7)

    def sketch(part: int, table: pa.Table, _: pa.Table | None) -> pa.Table:
        windows = Windows(table, window)
        return census.list_table([x for row in range(rows) for x in cells(windows, row, width_bits).lists(part, slices, row * slices)])

    counted = written(census.answered(census.per_part(stage.docs, None, sketch, census.LISTS)), "cells")

    def second(part: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        windows = Windows(table, window)
        maybe = estimated(windows, flags, rows, width_bits, slices)
        return census.list_table(list(exact_keys(windows, maybe).lists(part, slices, rows * slices)))

    exact = written(census.answered(census.per_part(stage.docs, counted, second, census.LISTS)), "windows")

    def cut(part: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        windows = Windows(table, window)
        maybe = np.flatnonzero(estimated(windows, flags, rows, width_bits, slices))
        found = np.zeros(len(windows.hashes[0]), dtype=bool)
        found[maybe] = census.counts(flags, rows * slices)[exact_keys(windows, maybe).which] >= 2
        columns, first = [], 0
        for texts, begin in windows.chunks:
            columns.append(without(texts, begin[found[first : first + len(begin)]], window, with_text))
            first += len(begin)
        arrays = [table.column("doc_id").combine_chunks(), *(pa.concat_arrays(x) for x in zip(*columns, strict=True))]
        return pa.Table.from_arrays(arrays, names=[f.split(" ")[0] for f in schema.split(", ")])

    schema = SCHEMA + (", kept string" if with_text else "")
    return census.per_part(stage.docs, counted.unionByName(exact), cut, schema)


def without(texts: Texts, begin: np.ndarray, window: int, with_text: bool) -> list[pa.Array]:
    """What is left of the texts without the words of these windows: the columns of SCHEMA after the id."""
    gone = covered(len(texts.begin), begin, begin + window)
    data, bounds = texts.joined(~gone)
    first = gone.copy()
    first[1:] &= ~gone[:-1] | (np.diff(texts.text_of_words()) > 0)
    kept = [data[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    columns = [
        pa.array(np.diff(texts.words)),
        pa.array(texts.per_text(gone)),
        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        pa.array(texts.per_text(first)),
    ]
    return columns + [pa.array([x.decode() for x in kept], pa.string())] * with_text
