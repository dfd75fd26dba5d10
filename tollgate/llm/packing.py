"""Documents packed into sequences of bounded length, by exact-complement hashing and best fit.

Every text becomes token ids with an end id. Only a document longer than a sequence is cut: its pieces fill sequences of their own
but the first, which has what is left over. So there are at most ``size`` lengths, and how many pieces have each length, a row of
``size`` numbers, is all that the plan needs.

The plan takes the longest piece left and looks for an exact complement of its gap: first a single length, then a pair, then a triple,
from hash tables of their sums. If there is none, the longest piece that fits goes in (best fit) and the rest of the gap is looked up again. A
combination found is used as often as the numbers of pieces allow, so each step uses up a length or at least halves it, and the number of
combinations is bounded by ``size`` whatever the size of the corpus.

The pieces are then numbered within their length: each task counts its own while it encodes, sums over the tasks before
are added by a window over a row for each task and length. Length and number tell a piece its sequence and its place there, by binary search in
the plan. No two pieces of a length meet in one task, nothing is sorted, and no text moves.

Defined cases: a null or empty text is one piece with the end id only. Repeated ids and rows are packed each by itself; null ids stay
null. Columns other than id and text are not read, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollgate.llm.token_files import byte_letters
from tollgate.llm.vectors import LONG
from tollgate.llm.vocab import IdStore
from tollgate.llm.words import Texts, chunks, prefix_hashes, ranges, span_hashes
from tollgate.session import written

SIZE = 2048
END_ID = 0
SPECIAL = b"<|endoftext|>"
# White space of more than one byte in UTF-8.
WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Spans that the splitting pattern leaves whole: a space at most, then letters, or digits, or marks without apostrophes.
WHOLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)")
SPACE, LETTER, MARK, LATIN = np.zeros((4, 256), dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True  # without the apostrophe, which starts a contraction
LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True  # second bytes of À to ÿ; the first is 0xC3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places at which the splitting pattern always cuts, and where what stands on either side is split as it is in the whole text: before
    white space; after a single white space that is no blank; before the last blank of a run; between a letter, of ASCII or from À
    to ÿ, and a mark. White space of several bytes is left uncut with what touches it."""
    n = len(data)
    out = np.zeros(n + 1, dtype=bool)
    out[bounds] = True
    if not n:
        return out
    space, plain = SPACE[data], data.tobytes()
    other = ~space
    for m in WIDE_SPACE.finditer(plain):
        other[m.start() : m.end()] = False
    blank = data == 0x20
    edge = out[1:n]  # before data[1:]
    before, after = other[:-1] & ~edge, other[1:] & ~edge
    edge |= before & space[1:]
    edge[: n - 1] |= after & space[:-1] & ~blank[:-1] & np.append(True, other[:-2] | out[1 : n - 1]) if n > 1 else False
    last = blank[:-1] & after
    out[: n - 1] |= last & (np.append(True, other[:-2] | space[:-2]) if n > 1 else True)
    if SPECIAL not in plain:
        letter = LETTER[data]
        letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
        starts = LETTER[data] | (data == 0xC3)
        starts[:-1] &= LETTER[data[:-1]] | LATIN[data[1:]]
        mark = MARK[data]
        out[1:n] |= (letter[:-1] & mark[1:]) | (mark[:-1] & starts[1:])
    return out


class SpanEncoder:
    """Ids of spans that ``cuts`` made. Those that the splitting pattern leaves whole go straight to the merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def __call__(self, spans: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        rest: list[str] = []
        tokenize, letters, whole = self.model.tokenize, self.letters, WHOLE.fullmatch
        for span in spans:
            if whole(span):
                out.append([t.id for t in tokenize(span.decode("latin-1").translate(letters))])
            else:
                rest.append(span.decode())
                out.append(None)
        others = iter(self.tokenizer.encode_batch(rest, add_special_tokens=False))
        return [x if x is not None else next(others).ids for x in out]


@lru_cache(maxsize=2)
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


@lru_cache(maxsize=2)
def id_store(path: str) -> IdStore:
    return IdStore()


def encode(texts: Texts, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``end_id``, and how many each text has."""
    places = np.flatnonzero(cuts(texts.data, texts.bounds))
    begin, end = places[:-1], places[1:]
    values = texts.data.astype(np.uint64) + np.uint64(1)
    hashes = [span_hashes(prefix_hashes(values, i), begin, end, i) for i in (0, 1)]

    def fresh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = texts.data.tobytes()
        ids = span_encoder(path)([data[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    ids, length = id_store(path).lookup(*hashes, fresh)
    owner = np.searchsorted(texts.bounds, begin, side="right") - 1
    counts = np.bincount(owner, weights=length, minlength=texts.n).astype(np.int64) + 1
    out = np.empty(int(counts.sum()), dtype="<u4")
    out[np.cumsum(counts) - 1] = end_id
    out[np.arange(len(ids)) + np.repeat(owner, length)] = ids
    return out, counts


def cut(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with so many ids each: the pieces' documents, numbers, starts and lengths."""
    n_pieces = -(-counts // size)
    first = counts - (n_pieces - 1) * size
    doc = np.repeat(np.arange(len(counts)), n_pieces)
    piece = ranges(np.zeros(len(counts), dtype=np.int64), n_pieces)
    start = np.where(piece > 0, first[doc] + (piece - 1) * size, 0)
    return doc, piece, start, np.where(piece > 0, size, first[doc])


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """PIECES (and the ids, with ``with_ids``) of all documents: ``nth`` counts the pieces of the same length before it in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch, texts in chunks(batches, "text"):
            ids, counts = encode(texts, vocabulary, end_id)
            doc, piece, start, length = cut(counts, size)
            ends = np.cumsum(length)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            of_length = np.bincount(length, minlength=size + 1)
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = ranges(seen, of_length)
            seen += of_length
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, LONG)]
            columns += [pa.array(np.full(len(length), task), pa.int32()), pa.array(nth)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class Complements:
    """Lengths, by the sums of one, two or three of them, while there are pieces left."""

    def __init__(self, counts: list[int], size: int):
        self.left, self.size = counts, size
        self.lengths = [n for n in range(1, size) if counts[n]]  # falling off as they are used up
        self.pairs: dict[int, list[int]] = {}
        for i, a in enumerate(self.lengths):
            for b in self.lengths[i:]:
                if a + b > size:
                    break
                self.pairs.setdefault(a + b, []).append(b)  # larger halves, rising

    def has(self, wanted: tuple[int, ...]) -> bool:
        return all(self.left[x] >= wanted.count(x) for x in set(wanted))

    def pair(self, total: int, besides: tuple[int, ...]) -> tuple[int, ...] | None:
        """The pair of this sum with the largest length; entries without pieces are taken out on the way."""
        entries = self.pairs.get(total)
        if entries is None:
            return None
        while entries and not (self.left[entries[-1]] and self.left[total - entries[-1]]):
            entries.pop()
        for b in reversed(entries):
            if self.has((*besides, b, total - b)):
                return b, total - b
        return None

    def exact(self, gap: int, besides: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap, in addition to the pieces ``besides``."""
        if self.has((*besides, gap)):
            return (gap,)
        if two := self.pair(gap, besides):
            return two
        for c in reversed(self.lengths):
            if c < gap and self.left[c] and (two := self.pair(gap - c, (*besides, c))):
                return (c, *two)
        return None

    def largest(self, gap: int, besides: tuple[int, ...]) -> int | None:
        """The longest length of at most ``gap`` of which a piece is left."""
        for n in reversed(self.lengths):
            if n <= gap and self.left[n] > besides.count(n):
                return n
        return None


@dataclass
class Plan:
    """Runs of pieces by length and number: from ``first`` on they go to the sequences from ``sequence`` on, ``each`` to a sequence, the
    first of them at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces. Runs lie in the order of (length, first)."""
        low, high = np.searchsorted(self.length, length), np.searchsorted(self.length, length, side="right")
        while (high - low > 1).any():  # all binary searches at once
            middle = (low + high) // 2
            right = (high - low > 1) & (self.first[np.minimum(middle, len(self.first) - 1)] <= number)
            low, high = np.where(right, middle, low), np.where(right | (high - low <= 1), high, middle)
        within = number - self.first[low]
        return self.sequence[low] + within // self.each[low], self.offset[low] + within % self.each[low] * length


def combinations(counts: list[int], size: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Lengths that share a sequence, and how many such sequences there are. ``counts`` is used up."""
    if counts[size]:
        yield (size,), counts[size]
    table = Complements(counts, size)
    while True:
        while table.lengths and not table.left[table.lengths[-1]]:
            table.lengths.pop()
        if not table.lengths:
            return
        chosen: tuple[int, ...] = (table.lengths[-1],)
        gap = size - chosen[0]
        while gap:
            if rest := table.exact(gap, chosen):
                chosen += rest
                break
            if (more := table.largest(gap, chosen)) is None:
                break
            chosen += (more,)
            gap -= more
        times = min(table.left[x] // chosen.count(x) for x in set(chosen))
        for x in chosen:
            table.left[x] -= times
        yield chosen, times
        if any(not table.left[x] for x in chosen):
            table.lengths = [x for x in table.lengths if table.left[x]]


def plan(counts: list[int], size: int = SIZE) -> Plan:
    """``counts[n]`` pieces have length n."""
    used, runs, sequence = [0] * (size + 1), [], 0
    for chosen, times in combinations(list(counts), size):
        offset = 0
        for x in sorted(set(chosen), reverse=True):
            each = chosen.count(x)
            runs.append((x, used[x], sequence, each, offset))
            used[x] += each * times
            offset += each * x
        sequence += times
    columns = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of each piece."""
    cut_up = written(pieces(docs, vocabulary, size, end_id, id_col, text_col, with_ids), "pieces")
    by_task = written(cut_up.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = [0] * (size + 1)
    for n, total in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[n] = total
    planned = plan(counts, size)
    upto = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    before = by_task.select("length", "task", F.coalesce(upto, F.lit(0)).alias("before"))
    numbered = cut_up.join(before, ["length", "task"]).withColumn("number", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    out = [*names[:5], "sequence_id", "offset", *names[5:]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = planned.place(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number")))
                made = {"sequence_id": pa.array(sequence, LONG), "offset": pa.array(offset, LONG)}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in out], names=out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return numbered.select(*names, "number").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces packed ``with_ids``: at most ``size`` ids a sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.flatten(F.transform(parts, lambda x: x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids")).select("sequence_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
