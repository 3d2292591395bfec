"""Reads of a segment: immutable rows with unique ascending keys. Filters on the key reach the Parquet scan."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, NumericType, StructField, StructType

from tarnwell.sources.shared import shared_folder


def first(segment: DataFrame, key: str) -> DataFrame:
    """The row with the least key."""
    return segment.orderBy(key).limit(1)


def seek(segment: DataFrame, key: str, target: object) -> DataFrame:
    """The first row at or after a target."""
    return first(segment.where(F.col(key) >= target), key)


def between(segment: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """Rows from low up to, without, high."""
    return segment.where((F.col(key) >= low) & (F.col(key) < high))


def _ranged(rows: DataFrame, key: str) -> tuple[DataFrame, list[tuple]]:
    """Rows with their range of a key, and each range's least key where `own` holds; a row for each range reaches the driver.

    Ranges of numbers are cut at quantiles. Keys of other types are dealt into ranges by Spark, which samples them, and written, so that a
    row's range is the same whenever it is read.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(rows.schema[key].dataType, NumericType):
        rows = rows.withColumn("__at", F.col(key).cast("double"))
        cuts = sorted(set(rows.approxQuantile("__at", [i / parts for i in range(1, parts)] or [0.5], 0.01) or [0.0]))
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__at", outputCol="__part").transform(rows).drop("__at").withColumn("__part", F.col("__part").cast("int"))
    else:
        path = shared_folder(spark)
        rows.where(F.col(key).isNotNull()).repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()).write.parquet(path)
        rows = spark.read.schema(rows.withColumn("__part", F.lit(0)).schema).parquet(path)
    least = rows.where("own").groupBy("__part").agg(F.min(key)).collect()
    return rows, sorted((r[0], r[1]) for r in least)


def _carried(rows: DataFrame, key: str, least: list[tuple]) -> DataFrame:
    """Rows with `carry`, the least key of the ranges after their own."""
    spark = rows.sparkSession
    parts = range(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1)
    after = [(p, next((k for q, k in least if q > p), None)) for p in parts]
    kind = StructType([StructField("__part", IntegerType()), StructField("carry", rows.schema[key].dataType)])
    return rows.join(F.broadcast(spark.createDataFrame(after, kind)), "__part", "left")  # a row for each range


def seek_many(segment: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """target, found: the first key at or after each distinct target (null past the end); keys of any type that sorts.

    Targets and keys meet in ranges of the key; what lies in a later range is carried as that range's least key. No
    non-equi join, and no range depends on another's rows.
    """
    both = segment.select(F.col(key).alias("k"), F.lit(True).alias("own")).unionAll(targets.distinct().select(F.col(targets.columns[0]).alias("k"), F.lit(False).alias("own")))
    ranged, least = _ranged(both, "k")
    rows = _carried(ranged, "k", least)
    # downwards, so that the frame only grows: a frame that shrinks is evaluated anew for each row
    ahead = Window.partitionBy("__part").orderBy(F.desc("k")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.coalesce(F.min(F.when(F.col("own"), F.col("k"))).over(ahead), F.col("carry"))
    return rows.withColumn("found", found).where("not own").select(F.col("k").alias("target"), "found")


def following(segment: DataFrame, key: str) -> DataFrame:
    """Each key and the next one (null at the end), range by range."""
    ranged, least = _ranged(segment.select(F.col(key).alias("k"), F.lit(True).alias("own")), "k")
    rows = _carried(ranged, "k", least)
    after = F.lead("k").over(Window.partitionBy("__part").orderBy("k"))
    return rows.select(F.col("k").alias("key"), F.coalesce(after, "carry").alias("next_key"))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that a segment can't hold, as they come more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
