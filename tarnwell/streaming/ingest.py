"""Streams of mutations: batches append to a log once each, and a replay after a watermark gives the buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwell.functions.mutations import checked, coalesced


def ingest(stream: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of mutations to a log; each batch has a folder of its own, so a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        checked(rows).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(spark: SparkSession, log_path: str, after: int = -1, mode: str = "literal") -> DataFrame:
    """The buffer of all logged mutations with a seq after a watermark."""
    return coalesced(spark.read.parquet(log_path).where(F.col("seq") > after).select("key", "seq", "kind", "payload", "delta"), mode)
