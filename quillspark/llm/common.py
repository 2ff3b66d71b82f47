"""Shared vectorised text primitives and Spark helpers.

Text kernels work on the raw UTF-8 (or code point) buffers that Arrow hands
over, a bounded block of documents at a time, so that a worker's memory does
not depend on the partition's size and no Python loop runs per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in one block; a longer document is a block of its own.
BLOCK_BYTES = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = []

#: Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where neither it nor the context's own is set, a temporary one, but on a single machine only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that all executors share; what was shuffled for it is removed once it is written."""
    spark = df.sparkSession
    folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


class Table:
    """A DataFrame written to the shared folder as a table in buckets of an id, so that joins on the id don't shuffle it; ``drop`` removes its files."""

    def __init__(self, df: DataFrame, buckets: int, column: str):
        spark = df.sparkSession
        self.name = f"kept_{uuid.uuid4().hex}"
        self.path = f"{folder(spark)}/{self.name}"
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.select("*").write.bucketBy(buckets, column).option("path", self.path).option("compression", "none").saveAsTable(self.name)
        finally:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
        self.df = spark.table(self.name)

    def drop(self) -> None:
        spark = self.df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark puts a 64-bit integer in: its Murmur3 hash (seed 42) modulo the number of buckets."""
    wide = ids.astype(np.int64).view(np.uint64)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.full(len(ids), 42, np.uint32)
    for half in ((wide & np.uint64(0xFFFFFFFF)).astype(np.uint32), (wide >> np.uint64(32)).astype(np.uint32)):
        h = turn(h ^ turn(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return h.view(np.int32).astype(np.int64) % buckets


def whole(column: str) -> Column:
    """A column of ids as 64-bit integers; what is no such number counts as null."""
    return F.col(column).try_cast("long")


def release() -> None:
    """Give freed memory back to the system: workers outlive a task, and what they keep adds up on an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which decides for itself


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n, kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        both = []
        for base in (_P, _PINV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each symbols[start:end]; equal spans hash alike wherever they stand."""
    up, down = powers(len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of documents; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of the words of a block, in order.

    A word is a longest run of ASCII letters, digits and non-ASCII characters
    inside one document; ASCII capitals count as small letters.
    """
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = WORD[data]
    cut = is_word[1:] & ~is_word[:-1]
    stop = ~is_word[1:] & is_word[:-1]
    inner = offsets[1:-1]
    touching = inner[is_word[inner] & is_word[inner + 1]]
    cut[touching] = True
    stop[touching] = True
    start, end = np.flatnonzero(cut), np.flatnonzero(stop)
    doc = np.searchsorted(offsets, start, "right") - 1
    return span_hashes(LOWER[data], start, end), doc, start, end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
