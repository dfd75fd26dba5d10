"""Token ids of words, kept by each Python worker.

Words are known by two 64-bit hashes. The kept words lie in arrays sorted by the first hash, so all words
of a chunk are looked up at once, and millions of words take some ten bytes each beside their ids. Beyond
``limit`` words the store starts anew: it saves work only and never changes a result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tollgate.llm.words import ranges

LIMIT = 1_000_000
#: Gets places of words; returns their ids, one after the other, and how many each has.
Encode = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one member of each distinct pair, and for each element the number of its pair."""
    _, at, which = np.unique(first, return_index=True, return_inverse=True)
    if (second[at][which] == second).all():
        return at, which
    order = np.lexsort((second, first))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class IdStore:
    """Ids of known words."""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.first = self.second = np.zeros(0, dtype=np.uint64)
        self.begin = self.length = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        begin = np.cumsum(length) - length + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        all_first = np.concatenate([self.first, first])
        order = np.argsort(all_first, kind="stable")
        self.first = all_first[order]
        self.second = np.concatenate([self.second, second])[order]
        self.begin, self.length = np.concatenate([self.begin, begin])[order], np.concatenate([self.length, length])[order]

    def lookup(self, first: np.ndarray, second: np.ndarray, encode: Encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has. Words with equal hashes must have
        equal ids; ``encode`` gets the places of words that are new."""
        if not len(first):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        at, which = distinct_pairs(first, second)
        new = np.flatnonzero(self.find(first[at], second[at]) < 0)
        if len(new):
            if len(self.first) + len(new) > self.limit:
                self.clear()
                new = np.arange(len(at))
            self.add(first[at[new]], second[at[new]], *encode(at[new]))
        found = self.find(first[at], second[at])
        begin, length, ids = self.begin[found], self.length[found], self.ids
        lost = np.flatnonzero(found < 0)
        if len(lost):  # words whose first hash another word has too
            more, sizes = encode(at[lost])
            begin[lost], length[lost] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, more])
        return ids[ranges(begin[which], length[which])], length[which]
