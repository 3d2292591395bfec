"""Typed mutations: the log's schema, its operations, and how they coalesce to one per key.

A log has key, seq (a total order within a key), kind (PUT, DELETE, INC), payload (of a put) and delta (of an
increment). Keys sort by unsigned bytes, as strings and binaries both do here.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE, INC = 0, 1, 2
LOG = "key string, seq bigint, kind int, payload string, delta bigint"


def put(key: Column, seq: Column, value: Column) -> list[Column]:
    """Columns of a replacing write."""
    return _op(key, seq, PUT, value.cast("string"), F.lit(None))


def delete(key: Column, seq: Column) -> list[Column]:
    """Columns of a tombstone."""
    return _op(key, seq, DELETE, F.lit(None), F.lit(None))


def inc(key: Column, seq: Column, delta: Column) -> list[Column]:
    """Columns of a counter change."""
    return _op(key, seq, INC, F.lit(None), delta)


def _op(key: Column, seq: Column, kind: int, payload: Column, delta: Column) -> list[Column]:
    return [key.alias("key"), seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), payload.cast("string").alias("payload"), delta.cast("bigint").alias("delta")]


def checked(log: DataFrame) -> DataFrame:
    """The log; reading an empty key or an unknown kind raises."""
    bad = F.col("key").isNull() | (F.length("key") == 0) | ~F.coalesce(F.col("kind").isin(PUT, DELETE, INC), F.lit(False))
    return log.withColumn("kind", F.when(bad, F.raise_error(F.lit("a mutation needs a key and a known kind")).cast("int")).otherwise(F.col("kind")))


def _states(log: DataFrame) -> DataFrame:
    """Each mutation as the state of a run of one: reset (seq of the last put or delete) with head, what was added after it, last_seq."""
    resets, adds = F.col("kind") != INC, F.col("kind") == INC
    head = F.struct(F.col("kind").alias("kind"), F.when(F.col("kind") == PUT, F.col("payload")).alias("payload"))
    return log.select("key", F.when(resets, F.col("seq")).alias("reset"), F.when(resets, head).alias("head"), F.when(adds, F.col("delta")).alias("added"), adds.alias("counting"), F.col("seq").alias("last_seq"))


def _merged(states: DataFrame, *by: str) -> DataFrame:
    """The states of runs that follow each other, as one per group: the last reset stands, what comes after it adds up."""
    rows = states.withColumn("top", F.max("reset").over(Window.partitionBy(*by)))
    after = F.col("top").isNull() | (F.col("last_seq") >= F.col("top"))
    return rows.groupBy(*by).agg(
        F.max("reset").alias("reset"),
        F.max(F.when(F.col("reset") == F.col("top"), F.col("head"))).alias("head"),
        F.sum(F.when(after, F.col("added"))).alias("added"),
        F.coalesce(F.max(F.when(after, F.col("counting"))), F.lit(False)).alias("counting"),
        F.max("last_seq").alias("last_seq"),
    )


def coalesced(log: DataFrame, mode: str = "literal", ranges: int | None = None) -> DataFrame:
    """key, kind, payload, delta, last_seq: one row per key.

    literal: the last put or delete stands; increments after it replace it and add up. sequential: increments after
    a put of an integer add to it, after a delete they begin at 0. The log is dealt by key and range of seq (as many ranges as shuffle
    partitions) and folded there; a key that holds most of the log is spread over all ranges, and only a row for each range and key meets
    again. One pass over seq for the ranges, then one over the log.
    """
    if mode not in ("literal", "sequential"):
        raise ValueError(mode)
    ranges = ranges or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(log.select(F.col("seq").cast("double").alias("seq")).approxQuantile("seq", [i / ranges for i in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    rows = _states(log).withColumn("at", F.col("last_seq").cast("double"))
    rows = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="at", outputCol="place").transform(rows).withColumn("range", F.col("place").cast("int")).drop("at", "place")
    one = _merged(_merged(rows, "key", "range").drop("range"), "key")
    base, value, total = F.col("head.kind"), F.col("head.payload"), F.col("added")
    if mode == "literal":
        kind = F.when(F.col("counting"), INC).otherwise(base)
        payload, delta = F.when(~F.col("counting"), value), F.when(F.col("counting"), total)
    else:
        kind = F.when(base.isNull(), INC).when(F.col("counting"), PUT).otherwise(base)
        said = F.when(base == PUT, value.cast("bigint")).otherwise(0) + total
        payload = F.when(base.isNotNull() & F.col("counting"), said.cast("string")).when(base == PUT, value)
        delta = F.when(base.isNull(), total)
    return one.select("key", kind.cast("int").alias("kind"), payload.alias("payload"), delta.alias("delta"), "last_seq")


def coalesced_by_window(log: DataFrame) -> DataFrame:
    """The literal result in one shuffle, for logs without hot keys: a key's rows meet in one task."""
    own = Window.partitionBy("key")
    rows = log.withColumn("reset", F.max(F.when(F.col("kind") != INC, F.col("seq"))).over(own))
    tail = (F.col("kind") == INC) & (F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
    one = rows.groupBy("key").agg(F.max_by("kind", "seq").alias("kind"), F.max_by("payload", "seq").alias("payload"), F.sum(F.when(tail, F.col("delta"))).alias("delta"), F.max("seq").alias("last_seq"))
    return one.select("key", "kind", F.when(F.col("kind") == PUT, F.col("payload")).alias("payload"), F.when(F.col("kind") == INC, F.col("delta")).alias("delta"), "last_seq")


def varint(n: int) -> bytes:
    """A signed integer as a zigzag base-128 varint."""
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def varint_len(n: int) -> int:
    """Bytes of a varint."""
    return max(1, -(-((n << 1) ^ (n >> 63)).bit_length() // 7))


def unvarint(raw: bytes) -> int:
    """The inverse of varint; raises where the bytes are no whole varint of 64 bits."""
    if not raw or raw[-1] > 127 or len(raw) > 10 or (len(raw) == 10 and raw[9] > 1) or any(b < 128 for b in raw[:-1]):
        raise ValueError("not a varint")
    n = sum((b & 127) << 7 * i for i, b in enumerate(raw))
    return (n >> 1) ^ -(n & 1)
