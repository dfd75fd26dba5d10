"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending id order. A frame is compressed by itself and holds some of
them: their number, ids, token counts, token ids and which ids are not null. Behind the frames follow two
skippable frames: which documents each frame has, and the table of the public zstandard seekable
format, with compressed and plain size and a checksum (low half of xxhash64) of each frame. So any zstandard tool can
read the file, and a reader that wants some documents decompresses only their frames.

Documents are range-partitioned by id, and each task writes one file under a name of its own, first as
another name. What counts is the manifest, a table written by Spark: it names the file of the attempt that
succeeded. Null text has only the end id; null ids come first; equal ids are ordered by text.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollgate.llm.vocab import IdStore
from tollgate.llm.words import LOWER, Texts, chunks

END_ID = 1
FRAME_IDS = 1 << 18
# The public seekable format.
TABLE_MAGIC, INDEX_MAGIC, FOOTER_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80

MANIFEST = "part int, file string, n_docs long, n_ids long"
#: Cut words that the byte-level model takes as they are once lower-cased: letters with no other normal form, or marks.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+")
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
LETTER, MARK, LATIN = np.zeros((3, 256), dtype=bool)
LETTER[97:123] = True
MARK[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
LATIN[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True  # second bytes of ß to ÿ; the first is 0xC3


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of cut words. This tokenizer drops white space, lower-cases, and joins neither words across white space
    nor letters with marks, so the ids of a text are those of its cut words. Plain ones skip the normalizer and
    the splitting pattern, which leave them as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        rest: list[str] = []
        tokenize, letters, plain = self.model.tokenize, self.letters, PLAIN.fullmatch
        for word in words:
            if plain(text := word.decode()):
                out.append([t.id for t in tokenize(text if text.isascii() else word.decode("latin-1").translate(letters))])
            else:
                rest.append(text)
                out.append(None)
        others = iter(self.tokenizer.encode_batch(rest, add_special_tokens=False))
        return [x if x is not None else next(others).ids for x in out]


@lru_cache(maxsize=4)
def id_store(path: str, lower: bool) -> IdStore:
    return IdStore()


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places between a letter, of ASCII or from ß to ÿ, and a mark."""
    letter = LETTER[data]
    letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
    starts = LETTER[data] | (data == 0xC3)
    starts[:-1] &= LETTER[data[:-1]] | LATIN[data[1:]]
    mark, out = MARK[data], np.zeros(len(data) + 1, dtype=bool)
    out[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & starts[1:])
    return out


def encode(texts: Texts, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``end_id``, and how many each text has."""
    lower = LOWER[texts.data]
    plain = lower.tobytes()
    if simple := not any(x in plain for x in SPECIAL):  # strings of special tokens are found before lower-casing
        texts.data = lower
        texts.find_words(cuts(lower))
    else:
        texts.find_words()

    def fresh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = texts.data.tobytes()
        ids = word_encoder(path)([data[b:e] for b, e in zip(texts.begin[at].tolist(), texts.end[at].tolist(), strict=True)])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    ids, length = id_store(path, simple).lookup(texts.word_hashes(), texts.word_hashes(which=1), fresh)
    counts = texts.per_text(length) + 1
    out = np.empty(int(counts.sum()), dtype="<u4")
    out[np.cumsum(counts) - 1] = end_id
    owner = np.repeat(texts.text_of_words(), length)
    out[np.arange(len(ids)) + owner] = ids
    return out, counts


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes documents in order to an open file."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.pack = zstandard.ZstdCompressor(level=3)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.n_docs = self.n_ids = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents go into frames of about ``frame_ids`` ids; none is cut."""
        ends, at = np.cumsum(counts), 0
        while at < len(counts):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + self.frame_ids - self.size, side="right")))
            self.waiting.append((doc_ids[at:stop], valid[at:stop], counts[at:stop], ids[base : ends[stop - 1]]))
            self.size += int(ends[stop - 1] - base)
            at = stop
            if self.size >= self.frame_ids or at < len(counts):
                self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        docs, valid, counts, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        plain = struct.pack("<Q", len(docs)) + docs.astype("<i8").tobytes() + counts.astype("<u8").tobytes() + ids.astype("<u4").tobytes() + valid.astype("u1").tobytes()
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.index.append((len(docs), int(docs[0]), int(docs[-1])))
        self.n_docs, self.n_ids = self.n_docs + len(docs), self.n_ids + len(ids)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<Qqq", *x) for x in self.index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads frames of an open file by its seek table."""

    def __init__(self, file):
        self.file, end = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self.at(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table_at = end - 9 - 12 * n
        self.table = list(struct.iter_unpack("<III", self.at(table_at, 12 * n)))
        self.index = list(struct.iter_unpack("<Qqq", self.at(table_at - 8 - 24 * n, 24 * n)))
        self.starts = np.cumsum([0, *(c for c, _, _ in self.table)]).tolist()
        self.frames_read = 0

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        packed, size, checksum = self.table[i]
        plain = zstandard.ZstdDecompressor().decompress(self.at(self.starts[i], packed), max_output_size=size)
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        self.frames_read += 1
        (n,) = struct.unpack_from("<Q", plain)
        docs, counts = np.frombuffer(plain, "<i8", n, 8), np.frombuffer(plain, "<u8", n, 8 + 8 * n)
        ids = np.frombuffer(plain, "<u4", int(counts.sum()), 8 + 16 * n)
        valid = np.frombuffer(plain, "u1", n, size - n)
        ends = np.cumsum(counts.astype(np.int64)).tolist()
        for doc, known, begin, end in zip(docs.tolist(), valid.tolist(), [0, *ends], ends, strict=False):
            yield (doc if known else None), ids[begin:end]

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, or only the wanted ids; frames without one are not read."""
        want = None if wanted is None else set(wanted)
        for i, (_, low, high) in enumerate(self.index):
            if want is None or any(low <= x <= high for x in want):
                yield from (x for x in self.frame(i) if want is None or x[0] in want)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every text and write files in ascending id order, with their manifest, to ``folder``, which all
    executors reach. ``vocabulary`` is the tokenizer's file, at the same path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), ""
        system, base = place(folder)
        writer = out = None
        for batch, texts in chunks(batches, "text"):
            if writer is None:
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                out = system.open_output_stream(f"{base}/files/.{name}", compression=None)
                writer = Writer(out)
            ids, counts = encode(texts, vocabulary, end_id)
            key = batch.column(0)
            writer.add(pc.fill_null(key, 0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False), counts, ids)
        if writer is not None:
            writer.close()
            out.close()
            system.move(f"{base}/files/.{name}", f"{base}/files/{name}")
            columns = [[part], [name], [writer.n_docs], [writer.n_ids]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["part", "file", "n_docs", "n_ids"])

    system, base = place(folder)
    system.create_dir(f"{base}/files", recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) read from the files. ``start`` counts the ids of all documents
    before. With ``wanted``, a list that fits into a task, only frames that may hold those ids are decompressed, and start is null."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    manifest = manifest.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{base}/files/{name}") as file:
                    rows, held = [], 0
                    for doc, ids in Reader(file).documents(wanted):
                        at, start = (start if wanted is None else None), start + len(ids)
                        rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                        held += len(ids) if with_ids else 1
                        if held >= FRAME_IDS:
                            yield table(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield table(rows, with_ids)

    return manifest.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(run, schema)


def table(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
