"""Exact top-k by inner product, with sorted lists and no random access.

Vectors are dealt into blocks, queries into slices. For each dimension a block has the list of its components, sorted. A query
reads the lists from the end that suits its sign, all to the same depth. What was read gives every vector an
upper score: a component not yet read lies at or below the list's value at the depth; and a lower score, with the list's last
value in place of the unread ones. Vectors that cannot reach the bar are out. Reading stops when few are left, and
their scores are resolved.

The bar is a score that k vectors have at least: the k-th best of a few vectors of the block that are resolved first, the k-th
best lower score, or what a pilot block has shown: all queries are answered in the first block alone, then go to the
other blocks with their k-th best score. Queries of a slice are worked on together as matrices. A task holds one block and one slice. The k best of each block are then ranked by query.

Components are floor(scale * x), within 64 bits. Vectors that are null or hold null or non-finite components take no part;
missing components of a shorter vector count as zero. Candidates with the query's id are its own rows. A query id that occurs
with several vectors asks with the smallest of them, in the order of arrays. A null id is no query; as a candidate it comes last
among equal scores. Scores are exact at any size: where doubles are not, whole numbers of any length are used. A score
that is no long is null, and scores of 38 digits and more rank alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollgate.session import written

K = 10
SCALE = 1024
#: Vectors of a block, between these; queries of a slice.
BLOCK_ROWS = (8192, 65536)
SLICE_QUERIES = 16384
#: How far the lists are read, step by step.
DEPTHS = (0.5, 0.7, 0.8, 0.9)
#: So many vectors left are resolved without reading on, for each of the k.
RESOLVE = 8
#: So many vectors of a block are resolved first, for a bar.
FIRST = 512
#: Scores of a step that are held at a time.
CELLS = 1 << 22
NO_ID = np.iinfo(np.int64).max
DIGITS = 10**38 - 1
FOUND = "query_id long, vec_id long, score decimal(38,0)"


class Lists:
    """The sorted lists of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.whole = ids, vectors
        self.vectors = vectors.astype(np.float64)
        self.values = np.sort(self.vectors, axis=0)
        self.largest = np.abs(self.vectors).max(axis=0, initial=0)
        self.depths: list[float] = []  # at which each query stopped

    def bound(self, queries: np.ndarray, depth: float, upper: bool) -> np.ndarray:
        """Upper or lower scores (vectors x queries) when the lists have been read to this depth."""
        n, v = len(self.ids), self.vectors
        stop = max(1, math.ceil(depth * n))
        top, bottom = self.values[n - stop], self.values[stop - 1]
        plus, minus = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        if upper:
            return np.maximum(v, top) @ plus + np.minimum(v, bottom) @ minus
        return np.where(v >= top, v, self.values[0]) @ plus + np.where(v <= bottom, v, self.values[-1]) @ minus

    def best(self, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each query the ids and scores of the k best that reach its bar; equal scores go by id."""
        width = min(queries.shape[1], self.whole.shape[1])
        whole = np.zeros((len(queries), self.whole.shape[1]), dtype=np.int64)
        whole[:, :width] = queries[:, :width]
        out: list = [None] * len(whole)
        fits = np.abs(whole.astype(np.float64)) @ self.largest < 2.0**53
        for i in np.flatnonzero(~fits).tolist():
            rows = np.flatnonzero(self.ids != query_ids[i])
            out[i] = self.ranked(rows, (self.whole[rows].astype(object) @ whole[i].astype(object)).tolist(), k)
        step, fits = max(1, CELLS // max(1, len(self.ids))), np.flatnonzero(fits)
        for begin in range(0, len(fits), step):
            self.read(out, fits[begin : begin + step], query_ids, whole, bars.astype(np.float64), k)
        return out

    def read(self, out: list, at: np.ndarray, query_ids: np.ndarray, whole: np.ndarray, bars: np.ndarray, k: int) -> None:
        """Answer the queries at these places, depth by depth."""
        queries, bars = whole[at].astype(np.float64), bars[at]
        first = self.vectors[:FIRST] @ queries.T
        first[self.ids[:FIRST, None] == query_ids[at]] = -np.inf
        if len(first) > k:  # k vectors have these scores at least
            bars = np.maximum(bars, np.partition(first, len(first) - k, axis=0)[len(first) - k])
        for depth in DEPTHS:
            own = self.ids[:, None] == query_ids[at]
            if depth > DEPTHS[0] and len(self.ids) > k:
                low = self.bound(queries, depth, False)
                low[own] = -np.inf
                bars = np.maximum(bars, np.partition(low, len(low) - k, axis=0)[len(low) - k])
            alive = self.bound(queries, depth, True) >= bars
            alive[own] = False
            done = alive.sum(axis=0) <= RESOLVE * k if depth < DEPTHS[-1] else np.ones(len(at), dtype=bool)
            for i in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(alive[:, i])
                scores = self.vectors[rows] @ queries[i]
                reach = scores >= bars[i]
                out[at[i]] = self.ranked(rows[reach], scores[reach].astype(np.int64), k)
                self.depths.append(depth)
            at, queries, bars = at[~done], queries[~done], bars[~done]
            if not len(at):
                return

    def ranked(self, rows: np.ndarray, scores: np.ndarray | list[int], k: int) -> tuple[np.ndarray, list[int]]:
        if isinstance(scores, list):
            first = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
            return self.ids[rows[first]], [max(-DIGITS, min(DIGITS, scores[i])) for i in first]
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[first]], scores[first].tolist()


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def answers(dealt: DataFrame, k: int) -> DataFrame:
    """FOUND for rows (cell, kind, vec_id, vector, bar), sorted by cell and kind: a block's vectors, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, parts, lists = None, [], [], None
        for batch in batches:
            number, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key = batch.column(2).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            bars = batch.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.append((number[1:] != number[:-1]) | (kind[1:] != kind[:-1]), True)) + 1
            for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if begin == end:
                    continue
                if number[begin] != cell:
                    cell, ids, parts, lists = number[begin], [], [], None
                matrix = dense(batch.column(3).slice(begin, end - begin))
                if kind[begin] == 0:
                    ids.append(key[begin:end])
                    parts.append(matrix)
                    continue
                if not ids:
                    continue  # a block without vectors
                lists = lists or Lists(np.concatenate(ids), stacked(parts))
                found = lists.best(key[begin:end], matrix, bars[begin:end], k)
                at = np.concatenate([i for i, _ in found])
                scores = pa.array([Decimal(int(s)) for _, each in found for s in each], pa.decimal128(38, 0))
                asked = np.repeat(key[begin:end], [len(i) for i, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(at, mask=at == NO_ID), scores], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int | None = None,
    slice_queries: int = SLICE_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best; ``is_query`` is a condition on ``vec_id``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("vector")).where("vector is not null")
    asked = rows.where(is_query & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, n_asked = rows.agg(F.count("*"), F.count_distinct(F.when(is_query, F.col("vec_id")))).first()
    if block_rows is None:
        block_rows = min(max(n // (2 * vectors.sparkSession.sparkContext.defaultParallelism), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    blocks, slices = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_asked / slice_queries))

    def up_to(number: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))

    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))
    lists = rows.select(block.alias("block"), "vec_id", "vector", F.explode(up_to(slices)).alias("slice"))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
    cell = (F.col("block") * slices + F.col("slice")).alias("cell")

    def dealt(lists: DataFrame, asked: DataFrame, cells: int) -> DataFrame:
        both = lists.select(cell, F.lit(0).alias("kind"), "vec_id", "vector", F.lit(None).cast("double").alias("bar"))
        both = both.unionByName(asked.select(cell, F.lit(1).alias("kind"), "vec_id", "vector", "bar"))
        return both.repartitionByRange(cells, "cell").sortWithinPartitions("cell", "kind", "vec_id")

    first = asked.select("slice", "vec_id", "vector", F.lit(0).cast("long").alias("block"), F.lit(None).cast("double").alias("bar"))
    pilot = answers(dealt(lists.where("block = 0"), first, slices), k)
    if blocks > 1:
        pilot = written(pilot, "pilot")
        bars = pilot.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bar"))
        barred = asked.join(bars, "vec_id", "left").withColumn("block", F.explode(up_to(blocks))).where("block > 0")
        pilot = pilot.unionByName(answers(dealt(lists.where("block > 0"), barred, (blocks - 1) * slices), k))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = pilot.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    return ranked.withColumn("score", F.col("score").try_cast("long"))


def dense(lists: pa.ListArray) -> np.ndarray:
    """The vectors as rows of a matrix; shorter ones end in zeros."""
    values, length = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(length.max()) if len(length) else 0
    out = np.zeros((len(length), width), dtype=np.int64)
    out[np.arange(width) < length[:, None]] = values
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
