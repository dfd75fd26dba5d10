"""Quality rules with a suffix array of each text.

A suffix array of the words of all texts of a chunk is built by prefix doubling; a text ends in a mark
of its own, so no common prefix crosses texts. The longest common prefix (LCP) with a neighbour in that
order is the depth of the deepest LCP interval of a suffix, which is the longest substring that starts
there and occurs again in the text. The union of those spans is what repeats; a rule limits its share
of the text and the longest one.

Null text: no words, so it fails the base rules. Rows are judged one by one, so repeated rows and null
ids get a row each. Other columns than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.words import Texts, chunks, covered, mixed, prefix_hashes, span_hashes

MIN_WORDS = 20
WINDOW = 8
MAX_WINDOW_SHARE = 30
# The method's own limits, in words of maximal repeated substrings.
MIN_REPEAT = 6
MAX_SHARE = 35
LONGEST_REPEAT = 120
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "repeat_words long, longest_repeat long, base_failed boolean, kept boolean"
)
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS)] = True


def suffix_ranks(letters: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... letters, up to the suffix array's order.

    Each round sorts only the suffixes whose rank is still shared. A rank is the first place of its
    group in the order, so ranks of settled suffixes never change."""
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = letters[order][1:] != letters[order][:-1]
    place = np.arange(n)
    heads = np.maximum.accumulate(np.where(first, place, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = heads
    levels, step = [rank.astype(np.int32)], 1
    while True:
        alone = first & np.append(first[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return levels
        members = order[slots]
        key = (rank[members] << 32) | rank[np.minimum(members + step, n - 1)]
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[slots] = members  # groups keep their slots, since the old rank leads the key
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        first[slots] = fresh
        heads = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[members] = heads
        levels.append(rank.astype(np.int32))
        step *= 2


def longest_again(letters: np.ndarray, least: int) -> np.ndarray:
    """For each place, the length of the longest substring from there that occurs elsewhere, if at least
    ``least``, else 0. Needs a closing letter of its own after each text."""
    n = len(letters)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    levels = suffix_ranks(letters)
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    known = min(len(levels) - 1, max(least, 1).bit_length() - 1)  # levels[k] tells of 2 ** k letters
    left, right = order[:-1], order[1:]
    near = levels[known][left] == levels[known][right]
    left, right = left[near], right[near]
    depth = np.zeros(len(left), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(left + depth, n - 1)] == levels[k][np.minimum(right + depth, n - 1)]
        depth += same.astype(np.int64) << k
    depth[depth < least] = 0
    np.maximum.at(best, left, depth)
    np.maximum.at(best, right, depth)
    return best


def repeats(texts: Texts, least: int) -> np.ndarray:
    """The longest repeat that starts at each word of each text, within its text."""
    hashes = texts.word_hashes()
    owner = texts.text_of_words()
    letters = np.empty(len(hashes) + texts.n, dtype=np.uint64)
    place = np.arange(len(hashes)) + owner
    letters[place] = mixed(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    ends = texts.words[1:] + np.arange(texts.n)
    letters[ends] = np.uint64(1 << 63) + np.arange(texts.n, dtype=np.uint64)
    return longest_again(letters, least)[place]


def repeated_lines(texts: Texts) -> np.ndarray:
    """For each text, its lines with a word that are equal to an earlier line of it."""
    data, bounds = texts.data, texts.bounds
    stop = np.union1d(np.flatnonzero(data == 10), bounds[1:])  # a line ends before \n or with its text
    at_newline = np.zeros(len(data) + 1, dtype=bool)
    at_newline[:-1] = data == 10
    begin = np.concatenate([[0], stop[:-1] + at_newline[stop[:-1]]]) if len(stop) else stop
    begin = np.minimum(begin, stop)
    has_word = np.searchsorted(texts.begin, stop) > np.searchsorted(texts.begin, begin)
    begin, stop = begin[has_word], stop[has_word]
    owner = np.searchsorted(bounds, begin, side="right") - 1
    keys = span_hashes(prefix_hashes(data.astype(np.uint64) + np.uint64(1)), begin, stop)
    order = np.lexsort((keys, owner))
    again = np.zeros(len(keys), dtype=bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][again], minlength=texts.n)


def judge(texts: Texts, min_repeat: int, max_share: int, longest: int) -> dict[str, np.ndarray]:
    texts.find_words()
    n = np.diff(texts.words)
    best = repeats(texts, min(WINDOW, min_repeat))
    at = np.arange(len(best))
    in_windows = texts.per_text(covered(len(best), at[best >= WINDOW], (at + best)[best >= WINDOW]))
    in_repeats = texts.per_text(covered(len(best), at[best >= min_repeat], (at + best)[best >= min_repeat]))
    top = np.zeros(texts.n, dtype=np.int64)
    np.maximum.at(top, texts.text_of_words(), best)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])[texts.bounds]
    chars = np.diff(sums(((texts.data & 0xC0) != 0x80) & ~np.isin(texts.data, [9, 10, 11, 12, 13, 32])))
    failed = (n < MIN_WORDS) | (100 * in_windows > MAX_WINDOW_SHARE * n)
    bad = (100 * in_repeats > max_share * n) | (top > longest)
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": np.diff(sums(IS_SYMBOL[texts.data])),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": in_windows,
        "repeat_words": in_repeats,
        "longest_repeat": top,
        "base_failed": failed,
        "kept": ~failed & ~bad,
    }


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_share: int = MAX_SHARE,
    longest_repeat: int = LONGEST_REPEAT,
) -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``.

    Base: under 20 words, or over 30% of the words in 8-word windows found twice or more. The method
    rejects a text where maximal repeats of ``min_repeat`` words or more cover over ``max_share`` percent
    of the words, or one is longer than ``longest_repeat`` words. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            found = judge(texts, min_repeat, max_share, longest_repeat)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_share: int = MAX_SHARE, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """The rows whose text is kept by the rules, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text_col):
            yield part.filter(pa.array(judge(texts, min_repeat, max_share, longest_repeat)["kept"]))

    return docs.mapInArrow(run, docs.schema)
