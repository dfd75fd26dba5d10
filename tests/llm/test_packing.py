"""Packing against the library's ids, a plain cut, and bounds on the number of sequences."""

import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm import plain
from tollgate.llm import packing, words
from tollgate.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
PIECES = (
    " ", " ", " ", "\n", "\t", "\r", " ", " ", "　", "\x1c", "\x85", "a", "word", "é", "À", "×", "÷", "ü", "'", "s", "'s", "'re", ",", ".", "(", "-",
    "1", "23", "<|endoftext|>", "<|", "ß", "中", "😀", "ā", "\x00", "_", "·", "²",
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    rnd = random.Random(4)
    for _ in range(3000):
        texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 14))) for _ in range(4)] + [None]
        ids, counts = packing.encode(words.Texts(pa.array(texts)), PATH)
        expected = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected, texts


def test_cut():
    doc, piece, start, length = packing.cut(np.array([1, 10, 11, 20, 25]), 10)
    assert list(zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist(), strict=True)) == [
        (0, 0, 0, 1), (1, 0, 0, 10), (2, 0, 0, 1), (2, 1, 1, 10), (3, 0, 0, 10), (3, 1, 10, 10), (4, 0, 0, 5), (4, 1, 5, 10), (4, 2, 15, 10),
    ]


def best_fit(lengths, size):
    """Longest first, each to the fullest sequence that has room."""
    rooms = Counter()
    for n in sorted(lengths, reverse=True):
        room = min((r for r in rooms if r >= n and rooms[r]), default=None)
        if room is None:
            room = size
        else:
            rooms[room] -= 1
        rooms[room - n] += 1
    return sum(rooms.values())


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rnd = random.Random(seed)
    size = rnd.choice([7, 20, 64, 200])
    lengths = [min(size, max(1, int(rnd.choice([rnd.uniform(1, size), rnd.expovariate(8 / size), size / 3])))) for _ in range(rnd.choice([0, 1, 50, 2000]))]
    counts = [lengths.count(n) for n in range(size + 1)]
    plan = packing.plan(counts, size)
    places = defaultdict(list)
    for n in set(lengths):
        sequence, offset = plan.place(np.full(counts[n], n), np.arange(counts[n]))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            places[s].append((o, n))
    assert set(places) == set(range(plan.n_sequences))
    for held in places.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[0][0] == 0 and sum(held[-1]) <= size
    assert -(-sum(lengths) // size) <= plan.n_sequences <= best_fit(lengths, size) + max(1, len(lengths) // 100)
    assert len(plan.length) <= 16 * size


def test_exact_complements_come_first():
    combinations = dict(packing.combinations([0, 3, 1, 1, 1, 1, 1, 1, 1, 0, 0], 10))
    assert combinations == {(8, 2): 1, (7, 3): 1, (6, 4): 1, (5, 1, 1, 1): 1}
    assert dict(packing.combinations([0, 0, 2, 2, 0, 2, 0, 0, 0, 0, 0], 10)) == {(5, 5): 1, (3, 3, 2, 2): 1}  # 3 leaves 7: 3 + 2 + 2
    assert dict(packing.combinations([0, 0, 0, 5, 0, 0, 0, 0, 0, 0, 0], 10)) == {(3, 3, 3): 1, (3, 3): 1}


def test_pack(spark, table_of, library):
    docs = plain.texts_with_repeats(6, 60) + [(700, "a <|endoftext|> b" * 3), (701, "x" * 5000), (None, "tail")]
    rows = packing.pack(table_of(docs), PATH, size=128, with_ids=True).cache()
    expected = Counter()
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 128 or 128
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 128)], [*range(first, len(ids) + 1, 128)], strict=True)):
            expected[i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    got = rows.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(spans[-1]) <= 128
    assert len(held) <= -(-sum(r.length for r in got) // 128) * 1.02 + 1
    joined = {r.sequence_id: r.ids for r in packing.sequences(rows).collect()}
    assert joined.keys() == held.keys()
    assert all(joined[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)


def test_empty_table(spark, table_of):
    assert packing.pack(table_of([]), PATH).collect() == []
    assert [tuple(r) for r in packing.pack(table_of([(1, None)]), PATH).collect()] == [(1, 0, 0, 1, zlib.crc32(bytes(4)), 0, 0)]
