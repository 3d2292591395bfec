"""Segments as versioned Parquet tables: a key-sorted sink that commits through a manifest, and its source."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources.shared import create_once, delete, names, text_of

MANIFEST = "segment_id bigint, version bigint, dict_id int, path string, n_rows bigint, min_key string, max_key string"


class SegmentStore:
    """Segments below a root folder. A version is visible once its manifest file is there, which one writer alone can create.

    The manifest has a folder for each segment and a file for each version, so a read looks at its own segment's names only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entry(self, segment_id: int, version: int) -> str:
        return f"{self.root}/manifest/segment={segment_id:020d}/{version:020d}.json"

    def write(self, rows: DataFrame, segment_id: int, version: int, expected_keys: int = 0) -> None:
        """A new version, sorted by key in ranges; raises if it is there, if the id is 0, or if keys are empty or repeat.

        rows is computed once; its keys are checked where they lie written, before the version is visible. Keys are delta-coded, each
        as what it doesn't share with the one before.
        """
        if segment_id == 0:
            raise ValueError("a segment id can't be 0")
        if version in self.versions(segment_id):
            raise FileExistsError(self._entry(segment_id, version))
        path = f"{self.root}/segment={segment_id:020d}/version={version:020d}/{uuid.uuid4().hex}"
        out = rows.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd")
        out = out.option("parquet.writer.version", "v2").option("parquet.enable.dictionary#key", "false")
        if expected_keys:
            out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(expected_keys))
        out.parquet(path)
        keys = self.spark.read.parquet(path).select("key")
        empty = F.max((F.col("key").isNull() | (F.octet_length("key") == 0)).cast("int"))
        n, least, most, bad = keys.agg(F.count("*"), F.min("key").cast("string"), F.max("key").cast("string"), empty).first()
        if bad or not keys.groupBy("key").count().where("count > 1").isEmpty():
            delete(self.spark, path)
            raise ValueError("keys must be unique and not empty")
        entry = {"segment_id": segment_id, "version": version, "dict_id": 0, "path": path, "n_rows": n, "min_key": least, "max_key": most}
        try:
            create_once(self.spark, self._entry(segment_id, version), json.dumps(entry))
        except FileExistsError:
            delete(self.spark, path)
            raise

    def manifest(self) -> DataFrame:
        """One row per visible version."""
        if not names(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(f"{self.root}/manifest")

    def versions(self, segment_id: int) -> list[int]:
        """The visible versions of a segment, ascending."""
        return [int(x[:-5]) for x in names(self.spark, f"{self.root}/manifest/segment={segment_id:020d}") if x.endswith(".json")]

    def read(self, segment_id: int, version: int | None = None) -> DataFrame:
        """A version, the latest by default."""
        there = [v for v in self.versions(segment_id) if version in (None, v)]
        if not there:
            raise FileNotFoundError(f"segment {segment_id}")
        return self.spark.read.parquet(json.loads(text_of(self.spark, self._entry(segment_id, there[-1])))["path"])
