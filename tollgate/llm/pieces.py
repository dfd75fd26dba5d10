"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a SentencePiece BPE model with byte fallback. An agenda holds the candidate merges of
neighbouring symbols; the best one is taken until none is left. With dropout, a keyed hash
decides for each candidate (key, first, middle and last character) whether the agenda skips it, so a word gets
varied segmentations, the same ones in each run. Merges change only how a text is cut, so
decoding gives the text back. With ``dropout`` 0 the ids are those of the library.

No piece has a space behind another character, so a text falls into units (spaces, then other characters)
that can be encoded by themselves. The key of a unit is drawn from seed, document, copy of the document and place of the unit, so each
occurrence is varied by itself. The Python worker keeps of each unit its ids without dropout and the candidates its agenda meets. An
occurrence whose key skips none of them has these ids; the others go through the agenda again, all of a chunk
together: each round takes the best candidate of every unit.

A space and U+2581 share a piece in this format; U+2581 is written as its bytes, so it is not lost either.
Null and empty texts have no ids and decode to the empty text. Documents are encoded one by one; with equal ids and
equal texts they get equal ids, a null id counting as a value of its own, unless ``copy`` numbers them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.vocab import IdStore, distinct_pairs
from tollgate.llm.words import Texts, chunks, mixed, ranges

DROPOUT = 0.1
VARIANTS = 0  # keys that occurrences of a unit share; 0 gives each its own
SEED = 17
SPACE = "▁"
NONE = 1 << 30
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Units that a worker keeps; a record takes some hundred bytes.
KEPT_UNITS = 400_000
COLUMNS = "n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"


class PairTable:
    """Ranks of pairs in a hash table with two places for each key, for lookups of whole arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(10, (4 * len(keys)).bit_length())
        while not self.fill(keys, ranks):
            self.bits += 1

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide, shift = keys.astype(np.uint64), np.uint64(64 - self.bits)
        return (wide * A >> shift).astype(np.int64), (wide * B >> shift).astype(np.int64) + (1 << self.bits)

    def fill(self, keys: np.ndarray, ranks: np.ndarray) -> bool:
        self.keys, self.ranks = np.full(2 << self.bits, -2, dtype=np.int64), np.full(2 << self.bits, NONE, dtype=np.int64)
        one, two = (x.tolist() for x in self.places(keys))
        taken: dict[int, int] = {}
        for i in range(len(one)):
            place, turns = one[i], 0
            while place in taken and turns < 100:  # whoever sat there goes to its other place
                i, taken[place] = taken[place], i
                place, turns = (two[i] if place == one[i] else one[i]), turns + 1
            if place in taken:
                return False
            taken[place] = i
        at, which = np.array(list(taken), dtype=np.int64), np.array(list(taken.values()), dtype=np.int64)
        self.keys[at], self.ranks[at] = keys[which], ranks[which]
        return True

    def get(self, keys: np.ndarray) -> np.ndarray:
        one, two = self.places(keys)
        return np.where(self.keys[one] == keys, self.ranks[one], np.where(self.keys[two] == keys, self.ranks[two], NONE))


class Pieces:
    """Tables of a model: ids of characters, merges with their ranks, and the bytes of each piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.n = n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in plain}
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.id_of_rank = np.array(by_score, dtype=np.int64)
        rank = {i: r for r, i in enumerate(by_score)}
        merges = {}
        for text, i in ids.items():
            for cut in range(1, len(text)):
                if text[:cut] in ids and text[cut:] in ids:
                    merges[ids[text[:cut]] * n + ids[text[cut:]]] = rank[i]
        self.pairs = np.array(sorted(merges), dtype=np.int64)
        self.ranks = np.array([merges[k] for k in self.pairs.tolist()], dtype=np.int64)
        self.table = PairTable(self.pairs, self.ranks)
        self.id_of_char = np.arange(0x110000, dtype=np.int64) + n  # others stand for themselves, beyond the pieces
        for text, i in ids.items():
            if len(text) == 1:
                self.id_of_char[ord(text)] = i
        self.id_of_char[0x20], self.id_of_char[ord(SPACE)] = ids[SPACE], n + ord(SPACE)
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte_ids) < 256 or any(SPACE in t.lstrip(SPACE) for t in ids):
            raise ValueError("the model needs byte fallback, and spaces only in front of a piece")
        out = [b""] * n
        for text, i in ids.items():
            out[i] = text.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            out[i] = bytes([byte])
        self.out_length = np.array([len(x) for x in out], dtype=np.int64)
        self.out_begin = np.cumsum(self.out_length) - self.out_length
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.store = IdStore(KEPT_UNITS)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.get(np.where((left < self.n) & (right < self.n), left.astype(np.int64) * self.n + right, -1))

    def agenda(self, symbols: np.ndarray, length: np.ndarray, keys: np.ndarray, dropout: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all units; returns symbols and their number for each unit. ``met`` gets the candidates: units and spots."""
        bar = np.uint64(round(dropout * (1 << 53)))
        symbols = symbols.astype(np.int32)
        unit = np.repeat(np.arange(len(length), dtype=np.int32), length)
        first = (np.arange(len(symbols)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
        last = first + 1

        def candidates(at: np.ndarray) -> np.ndarray:
            """Ranks of the merges of the symbols at these places with the next ones."""
            right = np.minimum(at + 1, len(symbols) - 1)
            rank = np.where((unit[right] == unit[at]) & (right > at), self.rank_of(symbols[at], symbols[right]), NONE)
            if dropout or met is not None:
                real = np.flatnonzero(rank < NONE)
                at, right = at[real], right[real]
                spot = mixed(first[at].astype(np.uint64) * A + first[right].astype(np.uint64) * B + last[right].astype(np.uint64) * C)
                if met is not None:
                    met.append((unit[at], spot))
                if dropout:
                    rank[real[mixed(keys[unit[at]] ^ spot) >> np.uint64(11) < bar]] = NONE
            return rank

        rank = candidates(np.arange(len(symbols)))
        done_units, done_symbols = [], []
        while len(symbols):
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(symbols)), heads)
            open_ = best < (NONE << 32)
            if not open_.all():
                live = np.repeat(open_, np.diff(np.append(heads, len(symbols))))
                done_units.append(unit[~live])
                done_symbols.append(symbols[~live])
                if not open_.any():
                    break
                shift = np.cumsum(~live)
                best = best[open_]
                merge = (best & 0xFFFFFFFF) - shift[best & 0xFFFFFFFF]
                symbols, unit, first, last, rank = symbols[live], unit[live], first[live], last[live], rank[live]
            else:
                merge = best & 0xFFFFFFFF
            symbols[merge] = self.id_of_rank[rank[merge]]
            last[merge] = last[merge + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[merge + 1] = False
            symbols, unit, first, last, rank = symbols[keep], unit[keep], first[keep], last[keep], rank[keep]
            merge -= np.arange(len(merge))
            before = merge[(merge > 0)] - 1
            touched = np.concatenate([merge, before[unit[before] == unit[before + 1]]])
            rank[touched] = candidates(touched)
        unit, symbols = np.concatenate(done_units or [unit]), np.concatenate(done_symbols or [symbols])
        order = np.argsort(unit, kind="stable")
        return symbols[order].astype(np.int64), np.bincount(unit, minlength=len(length))

    def with_bytes(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write characters that have no piece as their bytes."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return symbols.astype(np.uint32), length
        chars, which = np.unique(symbols[odd] - self.n, return_inverse=True)
        texts = [[self.byte_ids[b] for b in chr(c).encode()] for c in chars.tolist()]
        table, sizes = np.array([x for t in texts for x in t], dtype=np.int64), np.array([len(t) for t in texts])
        pool = np.concatenate([symbols, table])
        begin, count = np.arange(len(symbols)), np.ones(len(symbols), dtype=np.int64)
        begin[odd], count[odd] = len(symbols) + (np.cumsum(sizes) - sizes)[which], sizes[which]
        unit = np.repeat(np.arange(len(length)), length)
        return pool[ranges(begin, count)].astype(np.uint32), np.bincount(unit, weights=count, minlength=len(length)).astype(np.int64)

    def encode(self, texts: Texts, doc_keys: np.ndarray, seed: int, dropout: float, variants: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        full = np.flatnonzero(np.diff(texts.bounds) > 0)
        padded = Texts(pa.array([], pa.string()))
        padded.n = texts.n
        padded.data = np.insert(texts.data, texts.bounds[full], 0x20)
        more = np.zeros(texts.n + 1, dtype=np.int64)
        more[full + 1] = 1
        padded.bounds = texts.bounds + np.cumsum(more)
        data = padded.data
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[1:-1] = ((data[1:] == 0x20) & (data[:-1] != 0x20)) | (data[1:] == 10) | (data[:-1] == 10)
        edge[padded.bounds] = True
        padded.begin = np.flatnonzero(edge[:-1])
        padded.end = np.append(padded.begin[1:], len(data))
        padded.words = np.searchsorted(padded.begin, padded.bounds)
        owner = padded.text_of_words()
        char = (data & 0xC0) != 0x80
        chars_before = np.concatenate([[0], np.cumsum(char)])
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")

        def segment(at: np.ndarray, keys: np.ndarray, dropout: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
            begin = chars_before[padded.begin[at]]
            length = chars_before[padded.end[at]] - begin
            symbols = self.id_of_char[codes[ranges(begin, length)]]
            return self.with_bytes(*self.agenda(symbols, length, keys, dropout, met))

        def fresh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """A unit's record: how many ids it has without dropout, the ids, and its candidates in two numbers each."""
            met: list = []
            ids, length = segment(at, np.zeros(len(at), dtype=np.uint64), 0.0, met)
            unit, spots = (np.concatenate(x) for x in zip(*met, strict=True))
            number = np.bincount(unit, minlength=len(at))
            spots = np.ascontiguousarray(spots[np.argsort(unit, kind="stable")]).view(np.uint32)
            sizes = np.stack([np.ones(len(at), dtype=np.int64), length, 2 * number])
            begin = np.cumsum(sizes, axis=1) - sizes + np.array([[0], [len(at)], [len(at) + len(ids)]])
            pool = np.concatenate([length.astype(np.uint32), ids, spots])
            return pool[ranges(begin.T.ravel(), sizes.T.ravel())], sizes.sum(axis=0)

        hashes, second = padded.word_hashes(), padded.word_hashes(which=1)
        at, which = distinct_pairs(hashes, second)
        pool, size = self.store.lookup(hashes[at], second[at], lambda new: fresh(at[new]))
        begin = np.cumsum(size) - size
        number = pool[begin].astype(np.int64)
        length, begin = number[which], begin[which] + 1
        if dropout:
            place = (np.arange(len(owner)) - padded.words[owner]).astype(np.uint64)
            draw = mixed(mixed(doc_keys[owner] + np.uint64(seed)) + place * A)
            keys = mixed(hashes + (draw % np.uint64(variants) if variants else draw) * B + np.uint64(seed))
            spots = (size - 1 - number) // 2
            spot = pool[ranges(np.cumsum(size) - 2 * spots, 2 * spots)].view(np.uint64)[ranges((np.cumsum(spots) - spots)[which], spots[which])]
            unit = np.repeat(np.arange(len(owner)), spots[which])
            skips = mixed(keys[unit] ^ spot) >> np.uint64(11) < np.uint64(round(dropout * (1 << 53)))
            varied = np.flatnonzero(np.bincount(unit[skips], minlength=len(owner)))
            ids, length[varied] = segment(varied, keys[varied], dropout)
            begin[varied] = len(pool) + np.cumsum(length[varied]) - length[varied]
            pool = np.concatenate([pool, ids])
        return pool[ranges(begin, length)], padded.per_text(length)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and their bounds; the space in front of a text is taken off."""
        length = self.out_length[ids]
        data = self.out_bytes[ranges(self.out_begin[ids], length)]
        stops = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
        keep = np.ones(len(data), dtype=bool)
        full = np.diff(stops) > 0
        keep[stops[:-1][full]] = data[stops[:-1][full]] != 0x20
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[stops]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """The tables of a model."""
    return Pieces(path)


def encode_pieces(
    docs: DataFrame,
    model: str,
    seed: int = SEED,
    dropout: float = DROPOUT,
    variants: int = VARIANTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    copy: Column | None = None,
) -> DataFrame:
    """One row per document: its id, bytes and tokens, unsigned crc32 of the ids (little-endian, 32 bits each), sha256 of the
    text decoded from them, whether that is the text itself, and, if wanted, the ``ids``. ``model`` is at the same path on every machine.
    ``copy`` is the number, from 0, of a row among those with one id and text: each is varied by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            tables = pieces(model)
            key, number = part.column(0), part.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            keys = mixed(pc.fill_null(key, -1).to_numpy(zero_copy_only=False).astype(np.uint64) + key.is_null().to_numpy(zero_copy_only=False) * A + number * C)
            ids, counts = tables.encode(texts, keys, seed, dropout, variants)
            data, bounds = tables.decode(ids, counts)
            same = bool(np.array_equal(bounds, texts.bounds) and np.array_equal(data, texts.data))
            ends = np.cumsum(counts)
            rows = zip((ends - counts).tolist(), ends.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), texts.bounds[:-1].tolist(), texts.bounds[1:].tolist(), strict=True)
            found = [
                (e - b, int(counts[i]), zlib.crc32(ids[s:t].tobytes()), hashlib.sha256(data[b0:e0].tobytes()).hexdigest(), same or data[b0:e0].tobytes() == texts.data[b:e].tobytes())
                for i, (s, t, b0, e0, b, e) in enumerate(rows)
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            columns = [key, *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True))]
            if with_ids:
                names.append("ids")
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(0) if copy is None else copy).cast("long").alias("copy"))
    return rows.mapInArrow(run, f"doc_id long, {COLUMNS}" + (", ids array<int>" if with_ids else ""))


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(model)
        for batch in batches:
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = tables.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = [data[b:e].tobytes().decode() if ok else None for b, e, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
