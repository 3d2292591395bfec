"""Leaves: ranges of keys with a buffer over a segment. Resolution, materialisation, routing, merging and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.mutations import DELETE, INC, PUT


def resolved(buffer: DataFrame, segment: DataFrame) -> DataFrame:
    """key, value, counter of the buffer over a segment (key, value, counter): one full outer join.

    No operation: the segment's row. A put replaces it, an increment adds to its counter (0 without one), a delete drops it.
    """
    both = segment.select("key", F.col("value").alias("v"), F.col("counter").alias("c")).join(buffer, "key", "full_outer")
    value = F.when(F.col("kind").isNull(), F.col("v")).when(F.col("kind") == PUT, F.col("payload"))
    counter = F.when(F.col("kind").isNull(), F.col("c")).when(F.col("kind") == INC, F.coalesce("c", F.lit(0).cast("bigint")) + F.col("delta"))
    return both.where(F.col("kind").isNull() | (F.col("kind") != DELETE)).select("key", value.alias("value"), counter.alias("counter"))


def read(buffer: DataFrame, segment: DataFrame, keys: DataFrame) -> DataFrame:
    """The resolved row of each wanted key that is there; both sides are cut to the keys first."""
    return resolved(buffer.join(keys, "key", "left_semi"), segment.join(keys, "key", "left_semi"))


def route(rows: DataFrame, key: str, leaves: list[tuple]) -> DataFrame:
    """rows with leaf_id, from (leaf_id, low) with ascending lows; a key belongs to the last leaf whose low isn't after it (before all, or null: null).

    The lows are one sorted array, halved as often as it takes: thousands of leaves cost a dozen comparisons a row, for keys of any type.
    """
    if not leaves:
        return rows.withColumn("leaf_id", F.lit(None).cast("int"))
    kind = rows.schema[key].dataType.simpleString()
    lows, ids = F.lit([low for _, low in leaves]).cast(f"array<{kind}>"), F.lit([i for i, _ in leaves]).cast("array<int>")
    begin = F.struct(F.lit(0).alias("lo"), F.lit(len(leaves)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        after = F.get(lows, mid) > F.col(key)
        lo, hi = F.when(after, acc["lo"]).otherwise(mid + 1), F.when(after, mid).otherwise(acc["hi"])
        return F.when(acc["lo"] < acc["hi"], F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(len(leaves).bit_length() + 1))
    place = F.aggregate(steps, begin, halve, lambda acc: acc["lo"])
    return rows.withColumn("leaf_id", F.when(F.col(key).isNotNull(), F.get(ids, place - 1)))


def sizes(rows: DataFrame, nbytes: str) -> DataFrame:
    """leaf_id, n_rows, bytes."""
    return rows.groupBy("leaf_id").agg(F.count("*").alias("n_rows"), F.sum(nbytes).cast("bigint").alias("bytes"))


def merge_candidates(sized: DataFrame, threshold: int, variance: int) -> DataFrame:
    """Leaves past their own threshold, which varies from leaf to leaf so that they don't all merge at once."""
    own = F.lit(threshold) + F.crc32(F.col("leaf_id").cast("string").cast("binary")) % variance
    return sized.withColumn("threshold", own).where("bytes > threshold")


def split_points(rows: DataFrame, key: str, nbytes: str) -> DataFrame:
    """leaf_id, split_key: the first key at which at least half of a leaf's bytes lie up to it."""
    w = Window.partitionBy("leaf_id").orderBy(key)
    at = rows.withColumn("upto", F.sum(nbytes).over(w)).withColumn("whole", F.sum(nbytes).over(Window.partitionBy("leaf_id")))
    return at.where(F.col("upto") * 2 >= F.col("whole")).groupBy("leaf_id").agg(F.min(key).alias("split_key"))
