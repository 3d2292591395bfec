"""A tree of leaves over a log: appends, merges that commit, splits, truncation and recovery.

Below a root lie log batches (mutations with a seq), segments (key, value, counter; a folder for each leaf and merge) and numbered states. A state
names every leaf with its lowest key, its segment and its watermark, the last seq that its segment holds. States are created once: the
highest is current, and of two writers that go on from the same one the second fails. Nothing else is ever changed, so whoever opens the
root finds the current state and, after its watermarks, the log: that is all of recovery.

Defined cases: an empty log or segment is no rows; mutations at or before their leaf's watermark raise when they are appended;
a null or empty key raises; a leaf with one key isn't split.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.mutations import LOG, checked, coalesced
from tarnwell.operators import leaf
from tarnwell.sources.shared import create_once, delete, names, text_of

SEGMENT = "key string, value string, counter bigint"


def row_bytes() -> Column:
    """Bytes of a segment's row, for sizes and splits."""
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 8).cast("bigint")


class Tree:
    """Leaves below a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> dict:
        """The current state; before the first, one leaf without a segment."""
        there = [x for x in names(self.spark, f"{self.root}/state") if x.endswith(".json")]
        if not there:
            return {"number": 0, "next": 1, "leaves": [{"leaf_id": 0, "low": "", "path": None, "watermark": -1}]}
        return json.loads(text_of(self.spark, f"{self.root}/state/{there[-1]}"))

    def _commit(self, state: dict, leaves: list[dict], next_: int) -> dict:
        now = {"number": state["number"] + 1, "next": next_, "leaves": sorted(leaves, key=lambda x: x["low"].encode())}
        create_once(self.spark, f"{self.root}/state/{now['number']:020d}.json", json.dumps(now))
        return now

    def _routed(self, rows: DataFrame, state: dict) -> DataFrame:
        return leaf.route(rows, "key", [(x["leaf_id"], x["low"]) for x in state["leaves"]])

    def _pending(self, rows: DataFrame, state: dict) -> DataFrame:
        """Mutations after their leaf's watermark, with leaf_id."""
        place = {x["leaf_id"]: i for i, x in enumerate(state["leaves"])}
        marks = F.lit([x["watermark"] for x in state["leaves"]]).cast("array<bigint>")
        by_place = leaf.route(rows, "key", [(place[x["leaf_id"]], x["low"]) for x in state["leaves"]])
        ids = F.lit([x["leaf_id"] for x in state["leaves"]]).cast("array<int>")
        return by_place.withColumn("late", F.col("seq") <= F.get(marks, F.col("leaf_id"))).withColumn("leaf_id", F.get(ids, F.col("leaf_id")))

    def append(self, log: DataFrame) -> None:
        """Add a batch of mutations to the log; one that is not newer than its leaf's segment raises."""
        rows = self._pending(checked(log), self.state())
        ok = F.when(F.col("late"), F.raise_error(F.lit("a mutation is at or before its leaf's watermark")).cast("bigint")).otherwise(F.col("seq"))
        rows.select("key", ok.alias("seq"), "kind", "payload", "delta").write.parquet(f"{self.root}/log/batch={uuid.uuid4().hex}")

    def log(self) -> DataFrame:
        """The mutations that no segment holds yet, with leaf_id."""
        batches = names(self.spark, f"{self.root}/log")
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.root}/log/{x}" for x in batches]) if batches else self.spark.createDataFrame([], LOG)
        return self._pending(rows, self.state()).where("not late").drop("late")

    def buffer(self) -> DataFrame:
        """One current operation for each key of the log."""
        return coalesced(self.log())

    def segment(self, leaf_ids: set[int] | None = None) -> DataFrame:
        """The rows of the leaves' segments."""
        paths = [x["path"] for x in self.state()["leaves"] if x["path"] and (leaf_ids is None or x["leaf_id"] in leaf_ids)]
        return self.spark.read.schema(SEGMENT).parquet(*paths) if paths else self.spark.createDataFrame([], SEGMENT)

    def scan(self) -> DataFrame:
        """key, value, counter: the buffer over the segments."""
        return leaf.resolved(self.buffer(), self.segment())

    def read(self, keys: DataFrame) -> DataFrame:
        """The same for some keys."""
        return leaf.read(self.buffer(), self.segment(), keys)

    def load(self, rows: DataFrame) -> dict:
        """Rows (key, value, counter) as the first leaf's segment."""
        state = self.state()
        if state["number"]:
            raise FileExistsError(self.root)
        path = self._written(rows.withColumn("leaf_id", F.lit(0)))
        return self._commit(state, [state["leaves"][0] | {"path": f"{path}/leaf_id=0"}], state["next"])

    def _written(self, rows: DataFrame) -> str:
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        rows.select("leaf_id", "key", "value", "counter").repartitionByRange("leaf_id", "key").sortWithinPartitions("leaf_id", "key").write.partitionBy("leaf_id").option("compression", "zstd").parquet(path)
        return path

    def candidates(self, threshold: int, variance: int = 1) -> DataFrame:
        """Leaves whose pending mutations are past their own threshold."""
        nbytes = F.octet_length("key") + F.coalesce(F.octet_length("payload"), F.lit(8))
        return leaf.merge_candidates(leaf.sizes(self.log().withColumn("nbytes", nbytes), "nbytes"), threshold, variance)

    def merge(self, leaf_ids: set[int] | None = None, split_bytes: int | None = None) -> dict:
        """Merge leaves' buffers into new segments (all leaves by default) and commit; the new state.

        A leaf whose merged rows take more than split_bytes becomes two new leaves with half of the bytes each. Merged first, then
        divided; the state that names the new leaves is the only thing that makes them, and the merge, visible.
        """
        state = self.state()
        own = {x["leaf_id"] for x in state["leaves"]} if leaf_ids is None else set(leaf_ids)
        log = self.log().where(F.col("leaf_id").isin(sorted(own)))
        marks = {r[0]: r[1] for r in log.groupBy("leaf_id").agg(F.max("seq")).collect()}  # a row for each leaf
        newest = max(marks.values(), default=-1)
        merged = leaf.resolved(coalesced(log.where(F.col("seq") <= newest)), self.segment(own))
        path = self._written(self._routed(merged, state))
        sizes = {r["leaf_id"]: r["bytes"] for r in self._sizes(path)}
        leaves, next_ = [x for x in state["leaves"] if x["leaf_id"] not in own], state["next"]
        to_split = {i for i, n in sizes.items() if split_bytes is not None and n > split_bytes}
        halves = self._halves(path, to_split)
        done = {}
        for x in (x for x in state["leaves"] if x["leaf_id"] in own):
            i, mark = x["leaf_id"], max(x["watermark"], marks.get(x["leaf_id"], -1))
            if i in halves:
                done[i] = (next_, next_ + 1)
                leaves += [{"leaf_id": next_, "low": x["low"], "path": None, "watermark": mark}, {"leaf_id": next_ + 1, "low": halves[i], "path": None, "watermark": mark}]
                next_ += 2
            else:
                leaves.append(x | {"path": f"{path}/leaf_id={i}" if i in sizes else None, "watermark": mark})
        if done:
            two = self.spark.read.schema(SEGMENT).parquet(*[f"{path}/leaf_id={i}" for i in sorted(done)])
            new = self._written(self._routed(two, {"leaves": sorted(leaves, key=lambda x: x["low"].encode())}))
            for x in leaves:
                if any(x["leaf_id"] in pair for pair in done.values()):
                    x["path"] = f"{new}/leaf_id={x['leaf_id']}"
        return self._commit(state, leaves, next_)

    def _sizes(self, path: str) -> list:
        rows = self.spark.read.schema(f"{SEGMENT}, leaf_id int").parquet(path) if any("=" in x for x in names(self.spark, path)) else self.spark.createDataFrame([], f"{SEGMENT}, leaf_id int")
        return leaf.sizes(rows.withColumn("nbytes", row_bytes()), "nbytes").collect()  # a row for each leaf

    def _halves(self, path: str, leaf_ids: set[int]) -> dict[int, str]:
        """Where leaves are to be split: not at their first key."""
        if not leaf_ids:
            return {}
        rows = self.spark.read.schema(f"{SEGMENT}, leaf_id int").parquet(path).where(F.col("leaf_id").isin(sorted(leaf_ids))).withColumn("nbytes", row_bytes())
        first = rows.groupBy("leaf_id").agg(F.min("key").alias("first"))
        cut = leaf.split_points(rows, "key", "nbytes").join(first, "leaf_id").where("split_key > first")
        return {r["leaf_id"]: r["split_key"] for r in cut.collect()}  # a row for each such leaf

    def truncate(self) -> int:
        """Delete log batches that segments hold whole; how many."""
        gone = 0
        for x in names(self.spark, f"{self.root}/log"):
            rows = self.spark.read.schema(LOG).parquet(f"{self.root}/log/{x}")
            if self._pending(rows, self.state()).where("not late").isEmpty():
                delete(self.spark, f"{self.root}/log/{x}")
                gone += 1
        return gone
