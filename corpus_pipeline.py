"""A training-data pipeline over documents: language, quality, near-duplicates, secrets, packing.

Every stage takes empty tables and keeps other columns, whatever their names, as they are; the last one returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm.langid import in_a_language
from tarnwell.llm.neardup import one_of_each
from tarnwell.llm.packing import packed, vocabulary
from tarnwell.llm.quality import only_kept
from tarnwell.llm.secrets import masked
from tarnwell.llm.textkit import new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from their labels. Null texts and texts without letters go; repeated rows go or stay together."""
    return in_a_language(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the forest keep. Null and empty texts fail the base rules; without good labels these alone decide."""
    return only_kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates. Texts without words all stay; null and repeated ids are reduced like others."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, n_chars to match. Null texts stay null; no row goes."""
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens with their buckets and batches. A null or empty text is a sequence of the end alone."""
    return packed(docs, vocabulary())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
#: SQL can express none of the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder, which the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
