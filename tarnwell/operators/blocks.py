"""Blocks of a segment: packing, index, sizes and membership filters.

A block takes 16 bytes and, for each entry, 12 bytes and its key and value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, ENTRY, TARGET = 16, 12, 4096


def entry_bytes(key: Column, value: Column) -> Column:
    """Bytes of an entry in a block."""
    return F.octet_length(key) + F.octet_length(value) + ENTRY


def packed(entries: DataFrame, target: int = TARGET) -> DataFrame:
    """Rows of (segment, key, value) with the block (from 0) that each goes to, filled one after the other.

    An entry that would take a block past the target begins the next; a larger entry has a block of its own.
    Each segment is one sorted stream; segments run beside each other.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, block, size = None, 0, HEAD
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for i, (s, n) in enumerate(zip(b.column("segment").to_pylist(), b.column("bytes").to_pylist(), strict=True)):
                if s != segment:
                    segment, block, size = s, 0, HEAD
                if size > HEAD and size + n > target:
                    block, size = block + 1, HEAD
                size += n
                out[i] = block
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("segment", "key", "bytes")], pa.array(out)], ["segment", "key", "bytes", "block"])

    rows = entries.select("segment", "key", entry_bytes(F.col("key"), F.col("value")).cast("bigint").alias("bytes"))
    dealt = rows.repartition("segment").sortWithinPartitions("segment", "key")
    return dealt.mapInArrow(work, "segment bigint, key string, bytes bigint, block bigint")


def index(blocks: DataFrame) -> DataFrame:
    """segment, block, separator (the last key), n_entries, bytes and offset of each block."""
    one = blocks.groupBy("segment", "block").agg(F.max("key").alias("separator"), F.count("*").alias("n_entries"), (F.sum("bytes") + HEAD).alias("length"))
    before = Window.partitionBy("segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")))


def find_block(index_: DataFrame, segment: int, key: str) -> DataFrame:
    """The block that may hold a key: the first whose separator is not before it; no row past the end."""
    return index_.where((F.col("segment") == segment) & (F.col("separator") >= key)).orderBy("separator").limit(1)


def bloom_size(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits (whole bytes, 64 at least) and hashes (1 to 30) of a membership filter for n keys at a rate p of false hits."""
    if n <= 0:
        return 64, 1
    m = max(-n * math.log(p) / math.log(2) ** 2, 64.0)
    k = min(max(round(m / n * math.log(2)), 1), 30)
    return -(-math.ceil(m) // 8) * 8, k


def bloom_sizing(counts: DataFrame, n: str, p: float = 0.01) -> DataFrame:
    """counts with the bits and hashes of a membership filter for column n."""
    c = F.col(n).cast("double")
    m = F.greatest(-c * F.lit(math.log(p) / math.log(2) ** 2), F.lit(64.0))
    bits = F.when(c > 0, F.ceil(F.ceil(m) / 8) * 8).otherwise(64)
    hashes = F.when(c > 0, F.greatest(F.lit(1), F.least(F.lit(30), F.round(m / c * F.lit(math.log(2))).cast("int")))).otherwise(1)
    return counts.withColumn("bits", bits.cast("bigint")).withColumn("hashes", hashes.cast("int"))
