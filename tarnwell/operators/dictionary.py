"""Compression dictionaries: training, registry rules and a codec by dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.sources.segfile import Dictionary, Registry

SIZE, LEVEL = 65_536, 3


def history(samples: DataFrame, order: str, sample: str, size: int = SIZE) -> DataFrame:
    """The first bytes of all non-empty samples in order, cut at size; only samples that reach into it are gathered."""
    rows = samples.select(F.col(order).alias("o"), F.col(sample).cast("binary").alias("s")).where(F.octet_length("s") > 0)
    few = rows.orderBy("o").limit(size).select("o", F.substring("s", 1, size).alias("s"))  # each has a byte at least
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: F.hex(x["s"])), "")
    return few.agg(F.unhex(F.substring(digits, 1, 2 * size)).alias("history"))


def trained(samples: DataFrame, order: str, sample: str, dict_id: int, size: int = SIZE, level: int = LEVEL, rows: int = 10_000) -> Dictionary:
    """A dictionary trained on at most `rows` samples, the first in order, of at most `size` bytes each.

    Where these are too few to train on, their history is the dictionary's content; no samples at all raise.
    """
    said = samples.select(F.col(order).alias("o"), F.substring(F.col(sample).cast("binary"), 1, size).alias("s")).where(F.octet_length("s") > 0)
    some = [bytes(r["s"]) for r in said.orderBy("o").limit(rows).collect()]
    try:
        raw = zstandard.train_dictionary(size, some, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(some)[:size]
    return Dictionary(dict_id, raw, level)


def group_of(leaf_id: Column, leaves: int = 16) -> Column:
    """The dictionary of a leaf: one for each group of leaves that lie beside each other, from 1."""
    return F.floor(leaf_id / leaves).cast("int") + 1


def survivors(uses: DataFrame, dict_id: str, at: str, limit: int) -> DataFrame:
    """The dictionaries that a registry of `limit` still holds: those used last; all if limit is 0 or less."""
    last = uses.groupBy(F.col(dict_id).alias("dict_id")).agg(F.max(at).alias("last_use"))
    return last if limit <= 0 else last.orderBy(F.desc("last_use"), "dict_id").limit(limit)


def unused(dictionaries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Dictionaries that no manifest row names."""
    return dictionaries.join(manifest, "dict_id", "left_anti")


def _each(rows: DataFrame, dict_id: str, column: str, dictionaries: list[Dictionary], way: str) -> DataFrame:
    raws = [(d.id, d.raw, d.level) for d in dictionaries]
    names = [n for n in rows.columns if n != column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Registry()
        for x in raws:
            known.add(Dictionary(*x))
        coded = known.compress if way == "pack" else known.decompress
        for b in batches:
            out = [None if x is None else coded(i, x) for i, x in zip(b.column(dict_id).to_pylist(), b.column(column).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.binary())], [*names, column])

    kinds = rows.select(*names, F.col(column).cast("binary").alias(column))
    return kinds.mapInArrow(work, kinds.schema)


def compressed(rows: DataFrame, dict_id: str, column: str, dictionaries: list[Dictionary]) -> DataFrame:
    """rows with a column compressed by the dictionary that each row names; nulls stay, an unknown dictionary raises."""
    return _each(rows, dict_id, column, dictionaries, "pack")


def decompressed(rows: DataFrame, dict_id: str, column: str, dictionaries: list[Dictionary]) -> DataFrame:
    """The inverse of compressed."""
    return _each(rows, dict_id, column, dictionaries, "unpack")
