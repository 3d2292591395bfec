"""Reads of a buffer: the coalesced log, one row per key, tombstones included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.mutations import PUT


def read(buffer: DataFrame, key: str) -> DataFrame:
    """The current operation of a key, tombstones visible."""
    return buffer.where(F.col("key") == key)


def get(buffer: DataFrame, key: str) -> DataFrame:
    """The value of a key, only if its current operation is a put."""
    return buffer.where((F.col("key") == key) & (F.col("kind") == PUT)).select("key", F.col("payload").alias("value"))


def scan(buffer: DataFrame, first: int | None = None) -> DataFrame:
    """All operations in key order, or the first few."""
    rows = buffer.orderBy("key")
    return rows if first is None else rows.limit(first)


def size(log: DataFrame) -> DataFrame:
    """Unique keys, tombstones counted; partial per task."""
    return log.select("key").distinct().agg(F.count("*").alias("n_keys"))


def read_many(buffer: DataFrame, keys: DataFrame) -> DataFrame:
    """Each wanted key with its current operation, or nulls."""
    return keys.join(buffer, "key", "left")
