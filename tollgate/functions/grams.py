"""Character n-grams of many texts at once, counted by sorting numbers.

The texts of a chunk are laid out as one array of letters. A gram becomes a number, with the row it is in as its last digits, and
one sort of these numbers brings equal grams of a row together. Texts are those of ``text.padded_words``: words with a blank at
each side, separated by line breaks, which no gram contains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tollgate.functions.memory import steady_heap

LOW, HIGH = 2, 5
CHARS_PER_CHUNK = 1 << 20
KEY_BITS = 62
BREAK = 10


class Tally(NamedTuple):
    """Distinct ``grams``, and how often (``count``) each occurs in which row: (``gram``, ``row``) ascending."""

    grams: pa.StringArray
    gram: np.ndarray
    row: np.ndarray
    count: np.ndarray


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about ``CHARS_PER_CHUNK`` characters; a longer text is a chunk of its own."""
    steady_heap()
    start, size, part = 0, 0, []
    for row, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= CHARS_PER_CHUNK:
            yield start, part
            start, size, part = row + 1, 0, []
    if part:
        yield start, part


def _strings(letters: np.ndarray) -> pa.StringArray:
    """One string for each row of code points."""
    n, width = letters.shape
    if not n or letters.max() < 0x80:
        data, ends = letters.astype(np.uint8).tobytes(), np.arange(1, n + 1) * width
    else:
        data = letters.astype("<u4").tobytes().decode("utf-32-le").encode()
        ends = np.cumsum((1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)).sum(axis=1))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data))


def _packed(rank: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, Callable[[np.ndarray], np.ndarray]]]:
    """(n, gram number at each place, its letters' ranks): a few bits for each letter."""
    key = rank
    for n in range(2, HIGH + 1):
        key = (key[:-1] << bits) | rank[n - 1 :]
        shifts = bits * np.arange(n - 1, -1, -1)
        yield n, key, lambda keys, shifts=shifts: (keys[:, None] >> shifts) & ((1 << bits) - 1)


def _nested(rank: np.ndarray, letters: int) -> Iterator[tuple[int, np.ndarray, Callable[[np.ndarray], np.ndarray]]]:
    """The same where the letters are too many for that: pairs, and pairs of pairs, are numbered first."""
    pairs, pair = np.unique(rank[:-1] * letters + rank[1:], return_inverse=True)
    fours, four = np.unique(pair[:-2] * len(pairs) + pair[2:], return_inverse=True)

    def two(keys):
        return np.stack([keys // letters, keys % letters], axis=1)

    def with_last(head):
        return lambda keys: np.column_stack([head(keys // letters), keys % letters])

    def both(keys):
        return np.column_stack([two(pairs[keys // len(pairs)]), two(pairs[keys % len(pairs)])])

    yield 2, rank[:-1] * letters + rank[1:], two
    yield 3, pair[:-1] * letters + rank[2:], with_last(lambda keys: two(pairs[keys]))
    yield 4, pair[:-2] * len(pairs) + pair[2:], both
    yield 5, four[:-1] * letters + rank[4:], with_last(lambda keys: both(fours[keys]))


def tallies(texts: Sequence[str]) -> Iterator[Tally]:
    """The grams of a chunk of texts, a tally for each length."""
    # Breaks at the end leave room for the longest gram.
    codes = np.frombuffer(("\n".join(texts) + "\n" * HIGH).encode("utf-32-le"), dtype="<u4")
    lengths = np.array([len(t) + 1 for t in texts])
    lengths[-1] += HIGH - 1
    row = np.repeat(np.arange(len(texts)), lengths)
    breaks = np.flatnonzero(codes == BREAK)
    room = np.repeat(breaks, np.diff(breaks, prepend=-1)) - np.arange(len(codes))
    present = np.zeros(0x110000, dtype=bool)
    present[codes] = True
    letters = np.flatnonzero(present)
    rank = (np.cumsum(present) - 1)[codes]
    bits = max(1, (len(letters) - 1).bit_length())
    packed = HIGH * bits + len(texts).bit_length() <= KEY_BITS
    for n, key, ranks in _packed(rank, bits) if packed else _nested(rank, len(letters)):
        if n < LOW:
            continue
        inside = room[: len(key)] >= n
        pairs = np.sort(key[inside] * len(texts) + row[: len(key)][inside])
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        gram, its_row = np.divmod(pairs[first], len(texts))
        count = np.diff(first, append=len(pairs))
        new = np.diff(gram, prepend=-1) != 0
        yield Tally(_strings(letters[ranks(gram[new])].reshape(-1, n)), np.cumsum(new) - 1, its_row, count)


def murmur3(strings: pa.StringArray, seed: int = 42) -> np.ndarray:
    """The 32-bit hash of the UTF-8 bytes that Spark's HashingTF takes."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8)
    sizes, out = np.diff(offsets), np.zeros(len(strings), dtype=np.uint32)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    def mixed(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    for size in np.unique(sizes):
        here = np.flatnonzero(sizes == size)
        bytes_ = data[offsets[here][:, None] + np.arange(size)].astype(np.uint32)
        words = np.zeros((len(here), -(-size // 4)), dtype=np.uint32)
        for i in range(size):
            words[:, i // 4] |= bytes_[:, i] << np.uint32(8 * (i % 4))
        h = np.full(len(here), seed, dtype=np.uint32)
        for i in range(words.shape[1]):
            h ^= mixed(words[:, i])
            if 4 * i + 4 <= size:
                h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[here] = h ^ (h >> np.uint32(16))
    return out.view(np.int32)
