"""Exact n-gram Jaccard join with a matrix of tokens and groups of similar documents.

1. Documents with equal shingle sets are one class; a class has one row from here on.
2. Shingles that no other class has cannot be shared. They are told by a sketch over the staged corpus, which can only
   take a shingle for shared, never for unique. A class whose unique shingles alone keep it below the threshold
   is done; most are.
3. The others are linked to pivots: classes with a common minimum hash are compared with one of them. What is linked forms
   components, so copies and near copies by the thousand never meet in pairs.
4. Classes are partitioned into groups of similar ones, of about ``GROUP`` members: pieces of a large component, or small components
   with a common minimum hash. A group's row of the matrix is the union of its shingles. A pair at the threshold shares one of the rarest
   shingles of either, so a class is asked of a group only if one of its rarest is among the group's, the group has another
   component, and position and size allow it. The group is opened if the overlap of the class with the union reaches what its smallest
   member needs. Of two groups the smaller one asks, and each asks itself.
5. An opened group gives the exact links of the class, but those only that join components still apart in that group.

So every two classes at the threshold end in one component, and no two below it are linked. Sets hold 64-bit
hashes of shingles; classes are told apart by 128 bits.

Null and empty texts have an empty set and no link; their component is their own id. Repeated rows keep a row each.
A row without id takes part and is left out when the smallest id is sought (null if there is none). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import census
from tollgate.llm.graph import components
from tollgate.llm.words import Texts, mixed, prefix_hashes, span_hashes, table_chunks
from tollgate.session import written

SHINGLE = 5
PERCENT = 75
GROUP = 256
PIVOT_ROUNDS = 2
CELLS_PER_BYTE = 8
SKIP = -1  # the slice number of rows that name a class listed by another part
U64 = np.uint64
CLASSES = "doc_id long, part long, n_shingles long, node binary"
SETS = "node binary, n long, unique long, sharing long, tokens array<long>, rarest array<long>"


class Shingles:
    """The distinct shingles of each text of a part."""

    def __init__(self, table: pa.Table, size: int):
        found, self.n_texts = [self.of(texts, size) for _, texts in table_chunks(table)], table.num_rows
        firsts = np.cumsum([0, *(n for _, _, n in found)])
        self.keys = np.concatenate([keys for keys, _, _ in found])
        self.owner = np.concatenate([owner + first for (_, owner, _), first in zip(found, firsts, strict=False)])
        self.sizes = np.bincount(self.owner, minlength=self.n_texts)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        # A set's name: two sums over its members, each scrambled in another way, so that order plays no part.
        names = [mixed(self.sums(mixed(self.keys ^ U64(salt))) + self.sizes.astype(np.uint64)) for salt in (0x5DEECE66D, 0xB5297A4D3F84D5B5)]
        self.names = [a.tobytes() + b.tobytes() for a, b in zip(*names, strict=True)]

    @staticmethod
    def of(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys in ascending order within each text, their texts, and the number of texts."""
        texts.find_words()
        words = np.diff(texts.words)
        owner = texts.text_of_words()
        at = np.arange(len(owner))
        begin = at[at + size <= texts.words[1:][owner]]
        short = np.flatnonzero((words > 0) & (words < size))  # the whole sequence is the one shingle
        begin = np.concatenate([begin, texts.words[short]])
        end = np.concatenate([begin[: len(begin) - len(short)] + size, texts.words[short + 1]])
        keys = span_hashes(prefix_hashes(texts.word_hashes(lower=True)), begin, end)
        owner = owner[begin]
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        return keys[new], owner[new], texts.n

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def listed(self, skip: set[bytes]) -> np.ndarray:
        """One text for each set, without the empty ones and those that another part lists."""
        first: dict[bytes, int] = {}
        for i, name in enumerate(self.names):
            if self.sizes[i] and name not in skip:
                first.setdefault(name, i)
        return np.array(sorted(first.values()), dtype=np.int64)


def skipped(control: pa.Table) -> set[bytes]:
    rows = zip(control.column("slice").to_pylist(), control.column("flags").to_pylist(), strict=True)
    return {name for number, name in rows if number == SKIP}


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the rarest members must be looked at, so that no partner is missed."""
    return n - -(-percent * n // 100) + 1


def near_sets(stage: census.Stage, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Classes that can have a partner, with the shingles that may be shared and the rarest among them (step 2)."""
    spread = classes.where("n_shingles > 0").select("node", "part").distinct()
    first = spread.groupBy("node").agg(F.min("part").alias("first"), F.count("*").alias("parts")).where("parts > 1")
    skip = spread.join(first, "node").where("part <> first")
    skip = skip.select("part", F.lit(SKIP).cast("long").alias("slice"), F.lit(0).cast("long").alias("n"), F.col("node").alias("flags"))
    skip = written(skip, "skip")
    width = U64(64 - min(63, max(16, (CELLS_PER_BYTE * stage.n_bytes).bit_length())))
    slices = stage.slices(7)

    def cells(sets: Shingles, texts: np.ndarray) -> tuple[np.ndarray, census.Keys]:
        mine = np.isin(sets.owner, texts)
        return mine, census.Keys(sets.keys[mine] >> width << width)

    def sketch(part: int, table: pa.Table, control: pa.Table) -> pa.Table:
        sets = Shingles(table, shingle)
        _, keys = cells(sets, sets.listed(skipped(control)))
        return census.list_table(list(keys.lists(part, slices)))

    counted = written(census.answered(census.per_part(stage.docs, skip, sketch, census.LISTS)), "cells")

    def survivors(part: int, table: pa.Table, control: pa.Table) -> pa.Table:
        sets = Shingles(table, shingle)
        texts = sets.listed(skipped(control))
        mine, keys = cells(sets, texts)
        count = np.zeros(len(sets.keys), dtype=np.int64)
        count[mine] = census.counts(control, 0)[keys.which]
        shared = sets.sums((count > 1).astype(np.uint64)).astype(np.int64)
        rows = []
        look = prefix_length(sets.sizes, percent) - (sets.sizes - shared)
        for i in texts[100 * shared[texts] >= percent * sets.sizes[texts]].tolist():
            a, b = sets.bounds[i], sets.bounds[i + 1]
            often, tokens = count[a:b], sets.keys[a:b]
            own = often > 1
            often, tokens = often[own], tokens[own]
            order = np.lexsort((tokens, often))[: max(int(look[i]), 0)]
            rows.append((sets.names[i], int(b - a), int(b - a - len(tokens)), int(often.sum()), tokens.view(np.int64), tokens[order].view(np.int64)))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return census.rows_table(rows, ["node", "n", "unique", "sharing", "tokens", "rarest"], types)

    return census.per_part(stage.docs, counted.unionByName(skip), survivors, SETS)


def pivot_links(sets: DataFrame, percent: int, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """Links of classes with the pivot of those that share a minimum hash (step 3). The pivot is the member whose shingles
    most other classes have: where copies were changed here and there, that is the text they were made from."""
    smallest = [F.array_min(F.transform("tokens", lambda t, r=r: F.xxhash64(t, F.lit(r)))) for r in range(rounds)]
    keyed = sets.where("size(tokens) > 0").select("node", "sharing", F.posexplode(F.array(*smallest)).alias("round", "key"))
    pivots = keyed.groupBy("round", "key").agg(F.max(F.struct("sharing", "node")).alias("first"), F.count("*").alias("members"))
    pivots = pivots.where("members > 1").select("round", "key", F.col("first.node").alias("pivot"))
    pairs = keyed.join(pivots, ["round", "key"]).where("node <> pivot").select("node", "pivot").distinct()
    left = sets.select("node", F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    right = sets.select(F.col("node").alias("pivot"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    both = pairs.join(left, "node").join(right, "pivot")
    both = both.withColumn("common", F.size(F.array_intersect("t1", "t2")))
    return both.where(100 * F.col("common") >= percent * (F.col("n1") + F.col("n2") - F.col("common"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def grouped(sets: DataFrame, group: int = GROUP) -> DataFrame:
    """Groups of similar classes (step 4): a large component is cut into groups of its own; the classes of small
    ones are pooled by minimum hash, whole components together. ``weight`` is a group's size and name."""
    key = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(0))))
    large = F.col("members") >= max(group // 4, 2)
    rows = sets.withColumn("key", F.when(~large, key))
    pools = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("pool"))
    rows = rows.join(pools, "key", "left")
    pieces = F.ceil(F.coalesce("pool", "members") / group).cast("long")
    piece = F.pmod(F.when(large, F.xxhash64("node")).otherwise(F.xxhash64("component")), pieces)
    name = F.concat_ws("-", F.when(large, F.hex("component")).otherwise(F.hex("key")), F.when(large, F.lit("c")).otherwise(F.lit("m")), piece.cast("string"))
    rows = written(rows.withColumn("group", name).select("node", "component", "n", "unique", "tokens", "rarest", "group"), "groups")
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    return written(rows.join(sizes, "group").withColumn("weight", F.struct("size", "group")).drop("size"), "grouped")


def group_links(sets: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """Links between components, from opened groups (steps 4 and 5). ``sets`` also has component and members."""
    placed = grouped(sets, group)
    posts = placed.select("node", "component", "group", "weight", "n", "unique", F.posexplode("rarest").alias("place", "token"))
    posts = written(posts.withColumn("rest", F.col("n") - F.col("unique") - F.col("place")), "posts")  # members from here on, in order of rarity
    tokens = posts.groupBy("token").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other")
    posts = posts.join(tokens.select("token"), "token")
    rows = posts.groupBy("token", "group", "weight").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most_rest"), F.min("component").alias("one"), F.max("component").alias("other")
    )
    asking = posts.select("token", "node", F.col("weight").alias("mine"), "component", "n", "rest")
    need = percent * (F.col("n") + F.greatest("low", F.ceil(F.col("n") * percent / 100)))
    fits = (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    fits &= (100 + percent) * F.least("rest", "most_rest") >= need
    fits &= (F.col("mine") <= F.col("weight")) & ((F.col("one") != F.col("component")) | (F.col("other") != F.col("component")))
    asked = asking.join(rows, "token").where(fits).select("node", "group").distinct()
    schema = "group string, kind int, node binary, component binary, n long, tokens array<long>"
    members = placed.join(asked.select("group").distinct(), "group", "left_semi").select("group", F.lit(0).alias("kind"), "node", "component", "n", "tokens")
    queries = asked.join(placed.select("node", "component", "n", "tokens"), "node").select("group", F.lit(1).alias("kind"), "node", "component", "n", "tokens")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.unionByName(queries).repartition(n, "group").sortWithinPartitions("group", "kind").select(*[f.split(" ")[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, opened = None, [], None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            lists = batch.column(5)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for i, (g, kind, component, size) in enumerate(zip(*columns, strict=True)):
                tokens = values[bounds[i] : bounds[i + 1]]
                if g != name:
                    name, held, opened = g, [], None
                if kind == 0:
                    held.append((component, size, tokens))
                    continue
                opened = opened or Group(held, percent)
                found += opened.links(component, size, tokens)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


class Group:
    """A group of classes: the union of their tokens, who has which, and which components are known to be one."""

    def __init__(self, members: list[tuple[bytes, int, np.ndarray]], percent: int):
        self.percent = percent
        self.components = [component for component, _, _ in members]
        self.sizes = np.array([size for _, size, _ in members], dtype=np.int64)
        tokens = np.concatenate([t for _, _, t in members])
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(members)), [len(t) for _, _, t in members])[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.append(self.first[1:], len(tokens))
        self.leader: dict[bytes, bytes] = {}

    def lead(self, component: bytes) -> bytes:
        while (up := self.leader.get(component, component)) != component:
            component = up
        return component

    def partners(self, size: int, tokens: np.ndarray) -> np.ndarray:
        """Members at the threshold."""
        fit = (100 * self.sizes >= self.percent * size) & (100 * size >= self.percent * self.sizes)
        if not fit.any():
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if (100 + self.percent) * len(at) < self.percent * (size + self.sizes[fit].min()):
            return np.zeros(0, dtype=np.int64)  # the bound: the group stays closed
        length = self.last[at] - self.first[at]
        owner = self.owner[np.repeat(self.first[at] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        common = np.bincount(owner, minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= self.percent * (size + self.sizes - common))

    def links(self, component: bytes, size: int, tokens: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Links of the asking component that join what was apart so far."""
        out = []
        for i in self.partners(size, tokens).tolist():
            other = self.components[i]
            mine, theirs = self.lead(component), self.lead(other)
            if mine != theirs:
                self.leader[max(mine, theirs)] = min(mine, theirs)
                out.append((component, other))
        return out


def join(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
    part_bytes: int = census.PART_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest id reachable by links of Jaccard
    similarity of ``percent`` or more."""
    stage = census.Stage(docs, id_col, text_col, part_bytes)

    def name(part: int, table: pa.Table, _: pa.Table | None) -> pa.Table:
        sets = Shingles(table, shingle)
        columns = [table.column("doc_id"), table.column("part"), pa.array(sets.sizes), pa.array(sets.names, pa.binary())]
        return pa.Table.from_arrays(columns, names=["doc_id", "part", "n_shingles", "node"])

    classes = written(census.per_part(stage.docs, None, name, CLASSES), "classes")
    sets = written(near_sets(stage, classes, shingle, percent), "sets")
    first = written(components(pivot_links(sets, percent)), "components")
    placed = sets.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("members"))
    second = components(group_links(placed.join(sizes, "component"), percent, group))
    moved = placed.select("node", "component").join(second.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    moved = moved.select("node", F.coalesce("root", "component").alias("root"))
    smallest = classes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    rooted = smallest.join(moved, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = written(rooted.select("node", "root").join(low, "root").select("node", "component_id"), "answer")
    out = classes.join(answer, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
