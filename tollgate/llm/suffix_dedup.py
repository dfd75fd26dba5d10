"""Remove repeated strings of 400 bytes by prefix-free parsing and suffix arrays.

Parsing: a rolling hash of 16 bytes marks places (one in 64); phrases run from mark to mark. A mark depends on its
bytes alone, so equal strings are cut alike wherever they stand. A window of 400 bytes has a *core*, the
phrases that lie in it as a whole, and two cut phrases at its ends. Windows with one core stand in a row, and
all of them together are the core's *reach*.

Most of the work is done on whole phrases: a core that occurs once has no repeated window, and a reach that occurs twice has only
repeated ones. Both are counted over the staged corpus without moving a text. What is left are cores that occur
with different surroundings, the ends of repeated passages. Their cut phrases are sent to the place of the core. There the
*dictionary* (what stands left, read backwards, sorted, with common prefixes) and the *parse* (core and what follows, sorted, with
common prefixes) are put in order, and combined: windows are sorted by the part left of the core and then by their place in the order of
the parse. Neighbours in that corpus order have the longest common prefix, which is the left part, the core, and the least common prefix
between their places; a window repeats if it reaches 400 bytes with a neighbour.

A core with very many surroundings is split by half of what a window needs beside it: each window has that half on the left or
the rest on the right, so no pair is parted. At the edge of a passage in many documents that half lies in the passage and is the same for
all. So the rows of each key are counted first, and the windows of a key with more than ``KEY_ROWS`` are counted one by one by their
hashes, like windows without a mark: no task gets all rows of such a key.

Windows stay within a document and are judged on the input. Null text is empty. Repeated rows and ids keep a row each and count as
further occurrences. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import census
from tollgate.llm.words import Texts, covered, mixed, prefix_hashes, ranges, span_hashes, table_chunks
from tollgate.session import written

LENGTH = 400
MARK = 16
GAP_BITS = 6
CELLS_PER_BYTE = 1  # about one core in 32 bytes
SHARD_ROWS = 40_000
KEY_ROWS = 5_000  # of a key that is put in order; a shard holds some eight of them on average
HASH_ROWS = 4_000
ANSWER = 1 << 40  # the slice number of answers from the corpus order
U64 = np.uint64
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ENDS = "key binary, before binary, after binary, need int, many boolean, part long, ref long"


@dataclass
class Cores:
    """The cores of a chunk: windows from first to last, the core's bytes from begin to end, and windows without a mark."""

    texts: Texts
    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bare: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]

    def spans(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        return span_hashes(self.hashes[which], begin, end, which)


def parse(texts: Texts, length: int, gap_bits: int) -> Cores:
    hashes = tuple(prefix_hashes(texts.data.astype(np.uint64) + U64(1), which) for which in (0, 1))
    at = np.arange(max(len(texts.data) - MARK + 1, 0))
    marks = at[span_hashes(hashes[0], at, at + MARK) >> U64(64 - gap_bits) == 0]
    doc = np.searchsorted(texts.bounds, marks, side="right") - 1
    inside = marks + MARK <= texts.bounds[doc + 1]
    marks, doc = marks[inside], doc[inside]
    start, stop = texts.bounds[doc], texts.bounds[doc + 1] - length  # first and last window of the text
    lead = np.ones(len(marks), dtype=bool)
    lead[1:] = doc[1:] != doc[:-1]
    before = np.where(lead, start - 1, np.append(0, marks[:-1])[: len(marks)])
    final = np.searchsorted(doc, doc, side="right") - 1  # the text's last mark
    number = np.arange(len(marks))
    # Windows whose first mark is this one lie behind the mark before it; their last mark runs from low to high.
    high = np.minimum(np.searchsorted(marks, np.minimum(marks, stop) + length - MARK, side="right") - 1, final)
    low = np.minimum(np.maximum(np.searchsorted(marks, before + 1 + length - MARK, side="right") - 1, number), final)
    count = np.where(stop > before, np.maximum(high - low + 1, 0), 0)
    a, b = np.repeat(number, count), ranges(low, count)
    following = np.where(b < final[a], marks[np.minimum(b + 1, max(len(marks) - 1, 0))], np.iinfo(np.int64).max >> 1)
    first = np.maximum(before[a] + 1, marks[b] + MARK - length)
    last = np.minimum(np.minimum(marks[a], stop[a]), following + MARK - length - 1)
    some = last >= first
    a, b, first, last = a[some], b[some], first[some], last[some]
    marked = covered(len(texts.data), first, last + 1)
    window = np.zeros(len(texts.data), dtype=bool)
    whole = np.flatnonzero(np.diff(texts.bounds) >= length)
    if len(whole):
        window = covered(len(texts.data), texts.bounds[whole], texts.bounds[whole + 1] - length + 1)
    return Cores(texts, first, last, marks[a], marks[b] + MARK, np.flatnonzero(window & ~marked), hashes)


class Part:
    """The cores of all chunks of a part, and the keys that are counted."""

    def __init__(self, table: pa.Table, length: int, gap_bits: int, width_bits: int):
        self.length = length
        self.chunks = [parse(texts, length, gap_bits) for _, texts in table_chunks(table)]
        join = lambda of: np.concatenate([of(c) for c in self.chunks])
        self.names = [join(lambda c, w=w: c.spans(c.begin, c.end, w)) for w in (0, 1)]
        self.reach = [join(lambda c, w=w: c.spans(c.first, c.last + length, w)) for w in (0, 1)]
        self.bare = [join(lambda c, w=w: c.spans(c.bare, c.bare + length, w)) for w in (0, 1)]
        for c in self.chunks:
            c.hashes = ()
        wide = U64(64 - width_bits)
        self.cores = census.Keys(self.names[0] >> wide << wide)

    def maybe(self, flags: pa.Table, slices: int) -> np.ndarray:
        """Counts of the cores, one where a core is known to be unique."""
        return census.counts(flags, 0, slices)[self.cores.which].astype(np.int64)

    def exact(self, count: np.ndarray) -> census.Keys:
        """Reaches of the cores that may repeat, then the windows without a mark."""
        first, second = (np.concatenate([self.reach[w][count > 1], self.bare[w]]) for w in (0, 1))
        return census.Keys(first, (second >> U64(32)).astype(np.uint32))

    def reaches(self, count: np.ndarray, flags: pa.Table, slices: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the reaches (zero for unique cores) and of the windows without a mark."""
        exact = census.counts(flags, slices, 2 * slices)[self.exact(count).which].astype(np.int64)
        reach = np.zeros(len(count), dtype=np.int64)
        reach[count > 1] = exact[: int((count > 1).sum())]
        return reach, exact[int((count > 1).sum()) :]

    def ends(self, count: np.ndarray, reach: np.ndarray) -> tuple[list[tuple], np.ndarray, list[tuple[int, int, int]]]:
        """Cores with other surroundings elsewhere, each as the rows (key, before, after, need) of its halves: the
        distinct rows in order, how often each occurs, and for each place in them (chunk, core, row)."""
        found, places, at = [], [], 0
        for number, c in enumerate(self.chunks):
            mine = slice(at, at + len(c.first))
            for i in np.flatnonzero((count[mine] > 1) & (count[mine] > reach[mine])).tolist():
                begin, end = int(c.begin[i]), int(c.end[i])
                need = self.length - (end - begin)
                left = c.texts.data[int(c.first[i]) : begin].tobytes()
                right = c.texts.data[end : int(c.last[i]) + self.length].tobytes()
                name = self.names[0][at + i].tobytes() + self.names[1][at + i].tobytes()
                for row in halves(name, left, right, need):
                    found.append(row)
                    places.append((number, i))
            at += len(c.first)
        rows = sorted(set(found))
        number = {row: i for i, row in enumerate(rows)}
        refs = [number[row] for row in found]
        return rows, np.bincount(np.array(refs, dtype=np.int64), minlength=len(rows)), [(c, i, r) for (c, i), r in zip(places, refs, strict=True)]


def halves(name: bytes, left: bytes, right: bytes, need: int) -> list[tuple[bytes, bytes, bytes, int]]:
    """Windows with half of what they need on the left of the core, and the others: each with the key that all equal ones share."""
    half = (need + 1) // 2
    rest = need - half + 1
    key = lambda side, context: hashlib.blake2b(name + side + context, digest_size=16).digest()
    out = []
    if need > 0 and len(left) >= half and need - min(len(right), need - half) <= len(left):
        out.append((key(b"<", left[len(left) - half :]), left, right[: need - half], need))
    if need > 0 and len(right) >= rest and need - len(right) <= min(len(left), half - 1):
        out.append((key(b">", right[:rest]), left[max(len(left) - half + 1, 0) :], right, need))
    return out


def common_prefixes(texts: list[bytes]) -> np.ndarray:
    """Lengths of the common prefixes of neighbours; zero for the first."""
    out = np.zeros(len(texts), dtype=np.int64)
    if len(texts) > 1:
        size = np.array([len(t) for t in texts])
        width = int(size.max()) + 1
        matrix = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)
        differ = matrix[1:] != matrix[:-1]
        differ[:, -1] = True
        out[1:] = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    return out


class RangeMinimum:
    """Minima over ranges, from minima over ranges of 1, 2, 4, ... places."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[begin:end], which must not be empty."""
        level = np.floor(np.log2(end - begin)).astype(np.int64)
        out = np.empty(len(begin), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][begin[at]], self.levels[k][end[at] - (1 << k)])
        return out


def corpus_order(keys: list[bytes], before: list[bytes], after: list[bytes], need: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """For each row, which of its windows repeat, by how much of them stands left of the core, from least to most."""
    n = len(keys)
    parse_order = sorted(range(n), key=lambda i: (keys[i], after[i]))
    parse_prefix = common_prefixes([after[i] for i in parse_order])
    parse_prefix[1:][[keys[a] != keys[b] for a, b in zip(parse_order, parse_order[1:], strict=False)]] = -1
    place = np.empty(n, dtype=np.int64)
    place[parse_order] = np.arange(n)
    backwards = [x[::-1] for x in before]
    order = sorted(range(n), key=lambda i: (keys[i], backwards[i]))
    prefix = common_prefixes([backwards[i] for i in order])
    prefix[1:][[keys[a] != keys[b] for a, b in zip(order, order[1:], strict=False)]] = -1
    low = need - np.array([len(x) for x in after], dtype=np.int64)
    high = np.array([len(x) for x in before], dtype=np.int64)
    # The part left of the core is named by the first row, in the dictionary's order, that ends alike.
    named = np.zeros(int(high.max(initial=0)) + 1, dtype=np.int64)
    names = []
    for j, i in enumerate(order):
        named[max(int(prefix[j]) + 1, 0) :] = j
        names.append(named[low[i] : high[i] + 1].copy())
    row = np.repeat(np.array(order, dtype=np.int64), [len(x) for x in names])
    left = np.concatenate([np.arange(low[i], high[i] + 1) for i in order]) if n else np.zeros(0, np.int64)
    group = np.concatenate(names or [np.zeros(0, np.int64)]) * (len(named) + 1) + left
    by = np.lexsort((place[row], group))
    group, left, row, at = group[by], left[by], row[by], place[row[by]]
    next_ = np.flatnonzero(group[1:] == group[:-1])
    minimum = RangeMinimum(parse_prefix)
    next_ = next_[minimum(at[next_] + 1, at[next_ + 1] + 1) >= need[row[next_]] - left[next_]]
    repeats = many[row]
    repeats[next_] = True
    repeats[next_ + 1] = True
    by = np.lexsort((left, row))
    return np.split(repeats[by], np.cumsum(high - low + 1)[:-1])


def ordered(table: pa.Table) -> pa.Table:
    """Answers for a shard's rows: of each row, which windows repeat."""
    keys, before, after = (table.column(c).to_pylist() for c in ("key", "before", "after"))
    need = table.column("need").to_numpy().astype(np.int64)
    found = corpus_order(keys, before, after, need, table.column("many").to_numpy().astype(bool))
    return answer_table(table.column("part").to_pylist(), table.column("ref").to_pylist(), found)


def answer_table(parts: list[int], refs: list[int], found: list[np.ndarray]) -> pa.Table:
    rows = [(p, ANSWER, ref, np.packbits(f).tobytes()) for p, ref, f in zip(parts, refs, found, strict=True) if f.any()]
    return census.rows_table(rows, ["part", "slice", "n", "flags"], [pa.int64()] * 3 + [pa.binary()])


class Windows:
    """The single windows of some rows of a part, known by hashes of their key, their place at the core and what they hold beside it."""

    def __init__(self, table: pa.Table):
        self.refs = table.column("ref").to_numpy().astype(np.int64)
        self.many = table.column("many").to_numpy(zero_copy_only=False).astype(bool)
        self.count = np.zeros(len(self.refs), dtype=np.int64)
        found = []
        for at in range(0, len(self.refs), HASH_ROWS):
            some = table.slice(at, HASH_ROWS)
            keys, before, after = (some.column(c).to_pylist() for c in ("key", "before", "after"))
            need = some.column("need").to_numpy().astype(np.int64)
            low = need - np.array([len(x) for x in after], dtype=np.int64)
            high = np.array([len(x) for x in before], dtype=np.int64)
            count = self.count[at : at + HASH_ROWS] = high - low + 1
            bounds = np.concatenate([[0], np.cumsum(high + need - low)])
            data = np.frombuffer(b"".join(x for pair in zip(before, after, strict=True) for x in pair), dtype=np.uint8)
            left = ranges(low, count)
            begin = np.repeat(bounds[:-1] + high, count) - left
            names = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
            hashes = []
            for which in (0, 1):
                beside = span_hashes(prefix_hashes(data.astype(np.uint64) + U64(1), which), begin, begin + np.repeat(need, count), which)
                hashes.append(mixed(beside + mixed(np.repeat(names[:, which], count) + left.astype(np.uint64))))
            found.append((hashes[0], (hashes[1] >> U64(32)).astype(np.uint32)))
        self.keys = census.Keys(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def repeats(self, flags: pa.Table) -> list[np.ndarray]:
        """For each row what ``corpus_order`` says."""
        found = census.counts(flags)[self.keys.which] > 1
        return np.split(found | np.repeat(self.many, self.count), np.cumsum(self.count)[:-1])


def counted(ends: DataFrame) -> DataFrame:
    """Answers for the rows of keys with many rows: their windows are counted one by one."""
    windows = ends.agg(F.sum(F.octet_length("before") + F.octet_length("after") - F.col("need") + 1)).first()[0] or 0
    slices = max(1, math.ceil(windows / census.SLICE_KEYS))

    def count(part: int, table: pa.Table, _: pa.Table | None) -> pa.Table:
        return census.list_table(list(Windows(table).keys.lists(part, slices)))

    def answer(part: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        mine = Windows(table)
        return answer_table([part] * len(mine.refs), mine.refs.tolist(), mine.repeats(flags))

    counts = written(census.answered(census.per_part(ends, None, count, census.LISTS)), "windows")
    return census.per_part(ends, counts, answer, census.FLAGS)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gap_bits: int = GAP_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = census.PART_BYTES,
    with_bytes: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256; with ``with_bytes`` also what is ``kept``, as
    binary, since a cut can part a character. ``length`` must be over 16."""
    stage = census.Stage(docs, id_col, text_col, part_bytes)
    width_bits = min(63, max(16, (CELLS_PER_BYTE * stage.n_bytes).bit_length()))
    slices = stage.slices(1 << (gap_bits - 1))
    read = lambda table: Part(table, length, gap_bits, width_bits)

    def count_cores(part: int, table: pa.Table, _: pa.Table | None) -> pa.Table:
        return census.list_table(list(read(table).cores.lists(part, slices)))

    cores = written(census.answered(census.per_part(stage.docs, None, count_cores, census.LISTS)), "cores")

    def count_reaches(part: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        parsed = read(table)
        return census.list_table(list(parsed.exact(parsed.maybe(flags, slices)).lists(part, slices, slices)))

    reaches = written(census.answered(census.per_part(stage.docs, cores, count_reaches, census.LISTS)), "reaches")
    flags = cores.unionByName(reaches)

    def send_ends(part: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        parsed = read(table)
        count = parsed.maybe(flags, slices)
        rows, times, _ = parsed.ends(count, parsed.reaches(count, flags, slices)[0])
        rows = [(*row, bool(times[i] > 1), part, i) for i, row in enumerate(rows)]
        types = [pa.binary()] * 3 + [pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        return census.rows_table(rows, [f.split(" ")[0] for f in ENDS.split(", ")], types)

    ends = written(census.per_part(stage.docs, flags, send_ends, ENDS), "ends")
    # At most one key for each KEY_ROWS rows, so this table is small.
    large = written(ends.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > KEY_ROWS).select("key"), "large")
    some = large.limit(1).count() > 0
    small = ends.join(large, "key", "left_anti") if some else ends
    shards = max(1, math.ceil(ends.count() / SHARD_ROWS))
    answers = small.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(ordered, census.FLAGS)
    flags = flags.unionByName(written(answers, "answers"))
    if some:
        flags = flags.unionByName(written(counted(ends.join(large, "key", "left_semi")), "large_answers"))

    def cut(part: int, table: pa.Table, flags: pa.Table) -> pa.Table:
        parsed = read(table)
        count = parsed.maybe(flags, slices)
        reach, bare = parsed.reaches(count, flags, slices)
        rows, _, places = parsed.ends(count, reach)
        answers = flags.filter(pc.equal(flags.column("slice"), ANSWER))
        answers = dict(zip(answers.column("n").to_pylist(), answers.column("flags").to_pylist(), strict=True))
        more: dict[int, list[int]] = {}
        for number, i, ref in places:
            if ref in answers:
                _, _, after, need = rows[ref]
                found = np.flatnonzero(np.unpackbits(np.frombuffer(answers[ref], np.uint8)))
                more.setdefault(number, []).extend((int(parsed.chunks[number].begin[i]) - (need - len(after)) - found).tolist())
        columns, at, bare_at = [], 0, 0
        for number, c in enumerate(parsed.chunks):
            whole = reach[at : at + len(c.first)] > 1
            alone = c.bare[bare[bare_at : bare_at + len(c.bare)] > 1]
            single = np.concatenate([alone, np.array(more.get(number, []), dtype=np.int64)])
            begin, end = np.concatenate([c.first[whole], single]), np.concatenate([c.last[whole], single]) + length
            columns.append(without(c.texts, begin, end, with_bytes))
            at, bare_at = at + len(c.first), bare_at + len(c.bare)
        arrays = [table.column("doc_id").combine_chunks(), *(pa.concat_arrays(x) for x in zip(*columns, strict=True))]
        return pa.Table.from_arrays(arrays, names=[f.split(" ")[0] for f in schema.split(", ")])

    schema = SCHEMA + (", kept binary" if with_bytes else "")
    return census.per_part(stage.docs, flags, cut, schema)


def without(texts: Texts, begin: np.ndarray, end: np.ndarray, with_bytes: bool) -> list[pa.Array]:
    """What is left of the texts without these spans: the columns of SCHEMA after the id."""
    gone = covered(len(texts.data), begin, end)
    sums = np.concatenate([[0], np.cumsum(gone)])[texts.bounds]
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = texts.bounds[(texts.bounds > 0) & (texts.bounds < len(gone))]
    first[inner] = gone[inner]  # a run ends with its text
    spans = np.concatenate([[0], np.cumsum(first)])[texts.bounds]
    data, bounds = texts.data[~gone], texts.bounds - sums
    kept = [data[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    columns = [pa.array(np.diff(texts.bounds)), pa.array(np.diff(sums)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
    return columns + [pa.array(kept, pa.binary())] * with_bytes
