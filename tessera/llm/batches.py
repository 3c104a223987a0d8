"""Whole-batch text work in numpy: word boundaries, hashes and n-gram hashes of many documents at once.

Every operator that runs Python reads Arrow batches and cuts them into pieces of about ``PIECE`` bytes,
so a task's memory does not depend on how many rows Spark puts into one batch. A document is never cut.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
U64 = np.uint64

#: White space is \x20 and \x09-\x0D; everything else belongs to a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.default_rng(20240117)
CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
FOLDED = CODES.copy()
FOLDED[0x41:0x5B] = CODES[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15 | 1
_own_dir: list[str] = []
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base to the powers 0..n-1 modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        n = max(n, PIECE + 64)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each span, equal for equal content wherever it stands."""
    n = len(codes)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(codes * up[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; len(words) - n + 1 values."""
    starts = np.arange(max(0, len(words) - n + 1))
    return span_hash(words, starts, starts + n)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1)
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


def pieces(at: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together, or one longer document."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of consecutive documents: byte spans, and in ``first`` the number of each document's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray = SPACED):
        self.data, self.at = data, at
        inside = table[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.docs = np.repeat(np.arange(len(at) - 1), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        return span_hash((FOLDED if fold else CODES)[self.data], self.starts, self.ends)

    def within(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are in one document."""
        return self.docs[: max(0, len(self.docs) - n + 1)] == self.docs[n - 1 :]


def sums(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sum of values for each of n documents."""
    return np.bincount(docs, weights=values, minlength=n)


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count-1 for each count, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list array of consecutive runs of values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


class Memo:
    """Runs of numbers by 64-bit key, remembered in a table of fixed size: a key gives way to another of its slot. Key 0 is not remembered."""

    def __init__(self, slots: int, room: int):
        self.slots, self.room = slots, room
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.n = np.zeros(self.slots, U64), np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32)
        self.flat, self.used = np.zeros(self.room, np.int32), 0

    def look(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of each key, one after the other, and how many each has. make(places), for one place of each key that is not
        known, gives these keys' numbers and how many each has."""
        if self.used > self.room // 2:
            self.clear()
        slot = (keys & U64(self.slots - 1)).astype(np.int64)
        start, n = self.at[slot], self.n[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != keys) | (keys == 0))
        if len(miss):
            new, one, where = np.unique(keys[miss], return_index=True, return_inverse=True)
            one = miss[one]
            values, count = make(one)
            if self.used + len(values) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(values), np.int32)])
            self.flat[self.used : self.used + len(values)] = values
            begin = self.used + np.cumsum(count) - count
            self.used += len(values)
            start[miss], n[miss] = begin[where], count[where]
            _, last = np.unique(slot[one], return_index=True)
            kept = slot[one[last]]
            self.key[kept], self.at[kept], self.n[kept] = new[last], begin[last], count[last]
        return self.flat[np.repeat(start, n) + runs(n)], n


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def map_texts(df: DataFrame, make: Callable[[], Callable], schema: str, limit: int = PIECE, text: int = 1) -> DataFrame:
    """mapInArrow over pieces of documents.

    make() is called once a task and returns f(batch, data, at) -> list of arrays (or None); batch is the piece as a
    record batch, data and at the bytes and offsets of column number ``text``. If f has an attribute ``end``, it is
    called after the last batch and yields further lists of arrays.
    """
    names = [x.split()[0].strip("`") for x in _fields(schema)]
    conf = df.sparkSession.conf
    if conf.get(ROWS, None) is None:  # texts are long: Spark's own number of rows would be some 30 MB a batch, in the JVM and in Python
        conf.set(ROWS, "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            data, at = buffers(batch.column(text))
            for lo, hi in pieces(at, limit):
                out = f(batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                if out is not None:
                    yield pa.RecordBatch.from_arrays(out, names)
        for out in getattr(f, "end", tuple)():
            yield pa.RecordBatch.from_arrays(out, names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset and all work is on one machine, as in
    tests, a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not where and not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (where or _own_dir[0]).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: it cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))
