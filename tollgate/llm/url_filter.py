"""URL filter by a sorted array of 64-bit digests.

The list is one file: xxhash64 keys of its rules in ascending order, places of their strings, and the
strings themselves. Tasks map it into memory, so workers of a machine share its pages, and
look up all candidates of a batch by one vectorised binary search. A key that is found is confirmed by the
stored string, so two strings with one digest are told apart.

The file goes to the executors as a Spark file. That is a copy for each machine, so its size is checked
against ``max_bytes``; a larger list is refused.

Null urls and urls without ``://`` have empty host and path, so no rule fits. Rows are judged one by one.
"""

from __future__ import annotations

import atexit
import mmap
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 1 << 30
DEFAULT = "allow"
MAGIC = b"URLS0001"
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def write_list(rules: Iterable[tuple[str, str, str]], path: str) -> int:
    """Write rules (verdict, host, path) as a digest list; returns its bytes.

    Layout, little-endian: magic, number of rules, number of path lengths; the distinct path
    lengths (uint32); keys (uint64, ascending); places of the strings (uint64, one more than rules);
    verdicts (one byte, 1 blocks); strings. Of rules with one string the last counts."""
    verdicts = {host + path: (verdict == "block", len(path.encode())) for verdict, host, path in rules}
    by_key = sorted((xxhash.xxh64_intdigest(text.encode()), text.encode(), *verdicts[text]) for text in verdicts)
    lengths = sorted({n for *_, n in by_key})
    texts = [x[1] for x in by_key]
    with open(path, "wb") as out:
        out.write(MAGIC + struct.pack("<QQ", len(by_key), len(lengths)))
        out.write(np.array(lengths, dtype="<u4").tobytes().ljust(-(-4 * len(lengths) // 8) * 8, b"\0"))
        out.write(np.array([x[0] for x in by_key], dtype="<u8").tobytes())
        out.write(np.cumsum([0, *map(len, texts)], dtype="<u8").tobytes())
        out.write(bytes(x[2] for x in by_key) + b"".join(texts))
        return out.tell()


class DigestList:
    """A digest list mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError(f"{path} is not a digest list")
        n, n_lengths = struct.unpack("<QQ", self.map[8:24])
        at = 24
        self.lengths = np.frombuffer(self.map, "<u4", n_lengths, at).tolist()
        at += -(-4 * n_lengths // 8) * 8
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.places = np.frombuffer(self.map, "<u8", n + 1, at + 8 * n)
        self.blocks = np.frombuffer(self.map, "u1", n, at + 16 * n + 8)
        self.text_at = at + 17 * n + 8

    def text(self, i: int) -> bytes:
        return self.map[self.text_at + int(self.places[i]) : self.text_at + int(self.places[i + 1])]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The rule with each candidate's full string, or -1."""
        found = np.full(len(candidates), -1)
        if not candidates or not len(self.keys):
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        first = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == digests)
        for c in hit.tolist():
            i = int(first[c])
            while i < len(self.keys) and self.keys[i] == digests[c]:  # strings that share a digest
                if self.text(i) == candidates[c]:
                    found[c] = i
                    break
                i += 1
        return found


@lru_cache(maxsize=4)
def opened(path: str) -> DigestList:
    return DigestList(path)


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:stop].partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Every string a fitting rule can have: the host or a domain above it, with a beginning of the path."""
    at, domains = 0, [host]
    while (at := host.find(".", at) + 1) > 0:
        domains.append(host[at:])
    domains, path = [d.encode() for d in domains], path.encode()
    return [d + path[:n] for d in domains for n in lengths if n <= len(path)]


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every url. A rule (verdict, host, path) fits its host and all subdomains if
    the path starts with its own; the longest rule wins; without one the verdict is ``default``."""
    name = ship(pages.sparkSession, rules, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urls = opened(SparkFiles.get(name))
        for batch in batches:
            split = [parts(x) for x in batch.column(1).to_pylist()]
            tried, owner = [], []
            for i, (host, path) in enumerate(split):
                if host:
                    more = candidates(host, path, urls.lengths)
                    tried += more
                    owner += [i] * len(more)
            best: dict[int, int] = {}
            rule = urls.probe(tried)
            for c in np.flatnonzero(rule >= 0).tolist():
                if owner[c] not in best or len(tried[c]) > len(tried[best[owner[c]]]):
                    best[owner[c]] = c
            names = [tried[best[i]].decode() if i in best else None for i in range(len(split))]
            verdicts = [("block" if urls.blocks[rule[best[i]]] else "allow") if i in best else default for i in range(len(split))]
            columns = [batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in split], [p for _, p in split], names, verdicts))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, SCHEMA)


def ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]], max_bytes: int = MAX_BYTES) -> str:
    """Build the list on the driver and hand it to the executors; returns the name to open it by."""
    folder = tempfile.mkdtemp(prefix="urls-")  # the driver serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, f"urls-{uuid.uuid4().hex}").resolve()
    size = write_list(rules, str(path))
    if size > max_bytes:
        raise ValueError(f"the list has {size} bytes, more than max_bytes = {max_bytes}")
    spark.sparkContext.addFile(str(path))
    return path.name
