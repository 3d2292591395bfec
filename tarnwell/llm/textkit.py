"""Flat views of Arrow text columns: words, word hashes and shared-folder tables used by the operators.

A word is a maximal run of characters other than space and the five controls from tab to carriage return.
All of these are single bytes in UTF-8, so words are found on the raw bytes of an Arrow column, without
making Python strings.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 4 << 20
#: Rows that Spark hands to Python at once: bounds a batch of long texts.
BATCH_ROWS = 1000

U64 = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (the public splitmix64 constants)."""
    x = (x + U64(0x9E3779B97F4A7C15)).astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_RANDOM = mix64(np.arange(4096, dtype=U64)) | U64(1)


def randoms(n: int) -> np.ndarray:
    """The first n of a fixed sequence of odd 64-bit multipliers."""
    return _RANDOM[:n] if n <= len(_RANDOM) else mix64(np.arange(n, dtype=U64)) | U64(1)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that very long texts don't pile up in one; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 row offsets of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of the rows of one text column.

    starts, ends: byte positions; row: the word's row; first: n + 1 positions of each row's first word.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = flat(column)
        self.data = LOWER[data] if lower else data
        self.n_rows = len(self.offsets) - 1
        inside = _IS_WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before &= ~cut[:-1]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after &= ~cut[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.n_rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a multilinear hash of its bytes, finalised with its length."""
        n = self.ends - self.starts
        if not len(n):
            return np.zeros(0, U64)
        begin = np.cumsum(n) - n
        own = self.data[self.inside]
        at = np.arange(len(own)) - np.repeat(begin, n)
        parts = randoms(int(n.max()))[at] * (own.astype(U64) + U64(1))
        return mix64(np.add.reduceat(parts, begin) ^ (n.astype(U64) << U64(48)))


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; 0 for an empty range."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one, if all runs on one machine."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tarnwell.shared.dir", None)
    if not there:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tarnwell-")
        spark.conf.set("tarnwell.shared.dir", there)
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, as a URI for Spark."""
    return f"{shared_dir(spark)}/tarnwell-{name}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, as a path that every worker can open and map.

    Memory-mapped models need a mounted shared folder: a `file:` URI or a plain path.
    """
    path = new_path(spark, name)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    elif "://" in path:
        raise ValueError("memory-mapped models need spark.checkpoint.dir on a file system that workers mount")
    os.makedirs(path, exist_ok=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, whole when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with bounded batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)
