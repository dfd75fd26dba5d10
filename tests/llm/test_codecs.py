"""Pieces and token files: the libraries' ids, exact round trips, damaged and partly read files."""

import heapq
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from tollgate.llm import pieces, token_files
from tollgate.llm.queries import vocabulary
from tollgate.llm.vocab import IdStore
from tollgate.llm.words import Texts
from tollgate.session import new_path

ODD = [
    None, "", " ", "  two  spaces ", "▁ literal ▁▁", "line\n\nbreak\t\x00", "日本語 😀 é é", "İstanbul ΑΣ Σ ﬁ ½ ª×÷ ı",
    "It's FOO's we'll don'T 's x's. can't. a'.b .'s -'ll -é+a É.é.È-x", "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>.", "a" * 5000, "x",
]


def test_ids_are_the_librarys_without_dropout():
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    texts = [t for t in ODD if "▁" not in (t or "")] + [t for _, t in plain.texts_with_repeats(1, 40)]
    got, counts = pieces.Pieces(path).encode(Texts(pa.array(texts)), np.arange(len(texts), dtype=np.uint64), 1, 0.0, 8)
    library = SentencePieceProcessor(model_file=path)
    want = [library.encode(t or "") for t in texts]
    assert [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])] == want


def test_dropout_varies_but_loses_nothing(table_of):
    path = vocabulary("piece_bpe_32k.model")
    docs = list(enumerate(ODD)) + [(None, "null id"), (3, ODD[3]), (90, "internationalization of segmentations " * 400)]
    df = table_of(docs)
    encoded = pieces.encode_pieces(df, path, dropout=0.3, with_ids=True)
    rows = encoded.collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in rows) == sorted((i if i else -1 if i is None else 0 or -1, plain.sha(t or "")) for i, t in docs)
    back = pieces.decode_pieces(encoded, path).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((False, i, t or "") for i, t in docs if i is not None)
    again = pieces.encode_pieces(df, path, dropout=0.3, with_ids=True).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    other = pieces.encode_pieces(df, path, dropout=0.3, seed=5).where("doc_id = 90").first()
    mine = next(r for r in rows if r.doc_id == 90)
    assert other.ids_crc32 != mine.ids_crc32
    cut = ",".join(map(str, mine.ids))
    one = pieces.encode_pieces(df.where("doc_id = 90"), path, dropout=0.0, with_ids=True).first()
    assert len(one.ids) < len(mine.ids) and cut.count(",".join(map(str, one.ids[:8]))) < 300


def test_each_occurrence_is_varied_by_itself(table_of):
    """A unit with one merge loses it in a tenth of its places, a longer one has many segmentations, and copies have others."""
    path = vocabulary("piece_bpe_32k.model")
    docs = [(i, f"{c} " * 3999 + c) for i, c in enumerate("abcdefgh")] + [(50, "segmentations " * 3000)]
    rows = {r.doc_id: r.ids for r in pieces.encode_pieces(table_of(docs), path, with_ids=True).collect()}
    assert all(4300 < len(rows[i]) < 4500 for i in range(8))
    tables = pieces.Pieces(path)
    starts = np.flatnonzero(tables.out_bytes[tables.out_begin[rows[50]]] == 0x20)
    assert len({tuple(x) for x in np.split(rows[50], starts[1:])}) > 20
    df = table_of([(4, "internationalization of segmentations " * 20)] * 3)
    nth = F.row_number().over(Window.orderBy("doc_id")) - 1
    copies = pieces.encode_pieces(df.withColumn("nth", nth), path, copy=F.col("nth")).collect()
    assert len({r.ids_crc32 for r in copies}) == 3 and all(r.lossless for r in copies)


def test_copies_in_the_pipeline_are_varied(spark, table_of):
    docs = table_of([(4, "internationalization of segmentations " * 20)] * 3 + [(None, "internationalization of segmentations " * 20)])
    found = corpus_pipeline.encoded(spark, docs, "").collect()
    assert len({r.ids_crc32 for r in found}) == 4 and all(r.lossless for r in found)


def test_kept_ids_are_those_of_the_agenda():
    """With candidates noted that every key skips, all occurrences go through the agenda; the ids stay the same."""

    class All(pieces.Pieces):
        def agenda(self, symbols, length, keys, dropout, met=None):
            out = super().agenda(symbols, length, keys, dropout, met)
            if met is not None:
                met.extend([(np.repeat(np.arange(len(length)), 200), np.tile(np.arange(200, dtype=np.uint64), len(length)))])
            return out

    path = vocabulary("piece_bpe_32k.model")
    texts = Texts(pa.array([t for t in ODD if t] + [t for _, t in plain.texts_with_repeats(1, 40) if t]))
    keys = np.arange(texts.n, dtype=np.uint64)
    (some, counts), (every, more) = (kind(path).encode(texts, keys, 1, 0.1, 0) for kind in (pieces.Pieces, All))
    assert some.tolist() == every.tolist() and counts.tolist() == more.tolist()


M64 = (1 << 64) - 1


def scramble(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def agenda_with_a_heap(tables, text, key, dropout):
    """One unit, character by character, with the same key: the best candidate of a heap is merged until none is left."""
    n, merges = tables.n, dict(zip(tables.pairs.tolist(), tables.ranks.tolist(), strict=True))
    symbols = {i: (int(tables.id_of_char[ord(c)]), i + 1) for i, c in enumerate(text)}  # by first character: symbol, end
    before = {i + 1: i for i in range(len(text))}  # by end: first character
    heap = []

    def offer(i):
        left, middle = symbols[i]
        if middle in symbols:
            right, end = symbols[middle]
            rank = merges.get(left * n + right) if left < n and right < n else None
            spot = scramble((i * 0x9E3779B97F4A7C15 + middle * 0xC2B2AE3D27D4EB4F + end * 0x165667B19E3779F9) & M64)
            if rank is not None and scramble(key ^ spot) >> 11 >= round(dropout * 2**53):
                heapq.heappush(heap, (rank, i, middle, end))

    for i in list(symbols):
        offer(i)
    while heap:
        rank, i, middle, end = heapq.heappop(heap)
        if symbols.get(i, (0, 0))[1] != middle or symbols.get(middle, (0, 0))[1] != end:
            continue  # one of the two has been merged
        symbols[i] = (int(tables.id_of_rank[rank]), end)
        del symbols[middle]
        before[end] = i
        offer(i)
        if i in before and symbols.get(before[i], (0, 0))[1] == i:
            offer(before[i])
    out = []
    for i in sorted(symbols):
        s = symbols[i][0]
        out += [s] if s < n else [tables.byte_ids[b] for b in chr(s - n).encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.4])
def test_dropout_equals_an_agenda_with_a_heap(dropout):
    path = vocabulary("piece_bpe_32k.model")
    tables = pieces.Pieces(path)
    texts = [t for t in ODD if t and len(t) < 1000] + [t for _, t in plain.texts_with_repeats(1, 12) if t][:10] + ["segmentations of internationalization " * 40]
    keys = np.arange(1, len(texts) + 1, dtype=np.uint64) * np.uint64(977)
    seen = []
    for chunk in (texts, texts[::-1]):  # the second time most records are known
        order = keys if chunk is texts else keys[::-1]
        ids, counts = tables.encode(Texts(pa.array(chunk)), order, 3, dropout, 0)
        seen.append(dict(zip(order.tolist(), (x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])), strict=True)))
    assert seen[0] == seen[1]
    for text, doc_key in zip(texts, keys.tolist(), strict=True):
        units = [u for u in re.split(r"(?<=[^ ])(?= )|(?=\n)|(?<=\n)", " " + text) if u]
        want = []
        for place, unit in enumerate(units):
            alone = Texts(pa.array([unit]))
            alone.begin, alone.end = np.array([0]), np.array([len(alone.data)])
            draw = scramble((scramble(doc_key + 3) + place * 0x9E3779B97F4A7C15) & M64)
            key = scramble((int(alone.word_hashes()[0]) + draw * 0xC2B2AE3D27D4EB4F + 3) & M64)
            want += agenda_with_a_heap(tables, unit, key, dropout)
        assert seen[0][doc_key] == want, text


def test_full_dropout_leaves_characters():
    path = vocabulary("piece_bpe_32k.model")
    ids, counts = pieces.Pieces(path).encode(Texts(pa.array(["abc"])), np.zeros(1, np.uint64), 1, 1.0, 8)
    assert counts.tolist() == [4]


def test_files_hold_the_librarys_ids(spark, table_of):
    from tokenizers import Tokenizer

    path, folder = vocabulary("word_bpe_49k.json"), new_path(spark, "tokens")
    docs = list(enumerate(ODD, 5)) + plain.texts_with_repeats(2, 40)[:40]
    docs = [(i * 3 if i < 40 else i, t) for i, t in docs] + [(None, "no id")]
    token_files.write_tokens(table_of(docs), folder, path)
    got = token_files.read_tokens(spark, folder, with_ids=True).orderBy("start").collect()
    library, start = Tokenizer.from_file(path), 0
    want = sorted((i is not None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in docs if i is not None)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens
    some = token_files.read_tokens(spark, folder, with_ids=True, wanted=[15, 18, 77777]).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in some) == sorted((r.doc_id, list(r.ids)) for r in got if r.doc_id in (15, 18))


def packed(n=40, frame_ids=50):
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_ids)
    ids = np.arange(n * 7, dtype="<u4")
    writer.add(np.arange(n), np.ones(n, bool), np.full(n, 7), ids)
    writer.close()
    return out.getvalue()


def test_only_requested_frames_are_read():
    reader = token_files.Reader(pa.BufferReader(packed()))
    assert [(d, x.tolist()) for d, x in reader.documents([12])] == [(12, list(range(84, 91)))] and reader.frames_read == 1
    assert len(list(reader.documents())) == 40


def test_any_zstandard_reader_can_read_the_frames():
    import zstandard

    data = packed()
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
        plain_bytes = reader.read()
    assert len(plain_bytes) == sum(n for _, n, _ in token_files.Reader(pa.BufferReader(data)).table)


def test_damage_is_found():
    data = bytearray(packed())
    data[30] ^= 1
    with pytest.raises(Exception, match="damaged|decompression|zstd|Data corruption"):
        list(token_files.Reader(pa.BufferReader(bytes(data))).documents())
    with pytest.raises(ValueError, match="seek table"):
        token_files.Reader(pa.BufferReader(bytes(data[:-1])))


def test_store_survives_clashes_and_overflow():
    store, asked = IdStore(limit=3), []

    def encode(at):
        asked.append(at.tolist())
        return np.repeat(at, 2).astype(np.uint32), np.full(len(at), 2)

    first = np.array([5, 5, 6, 7, 5], dtype=np.uint64)
    second = np.array([1, 2, 1, 1, 1], dtype=np.uint64)
    ids, length = store.lookup(first, second, encode)
    assert length.tolist() == [2] * 5 and ids.tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 0, 0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_pieces(empty, vocabulary("piece_bpe_32k.model")).collect() == []
    folder = new_path(spark, "tokens")
    token_files.write_tokens(empty, folder, vocabulary("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, folder).where(F.lit(True)).collect() == []
