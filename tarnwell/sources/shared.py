"""Folders that driver and executors share, and files in them that are created once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The URI of a new folder below spark.checkpoint.dir; where that is unset, a temporary one, if all runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/tarnwell-{uuid.uuid4().hex}" if root else "file://" + tempfile.mkdtemp(prefix="tarnwell-") + "/t"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is created whole by one writer; FileExistsError for all others.

    It is written under another name and then renamed: file systems that Spark runs on refuse to rename onto a file that is there, or, like
    local ones, are asked first under a lock file that only one writer can create.
    """
    fs, there = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    lock, temp = jvm.org.apache.hadoop.fs.Path(f"{path}.lock"), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    if fs.exists(there):
        raise FileExistsError(path)
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        fs.create(lock, False).close()
    except Exception as e:
        fs.delete(temp, False)
        raise FileExistsError(path) from e
    if fs.exists(there) or not fs.rename(temp, there):
        fs.delete(temp, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder or file goes, if it is there."""
    fs, there = _hadoop(spark, path)
    fs.delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    fs, there = _hadoop(spark, path)
    return fs.exists(there)


def names(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Names of the files in a folder that fit a pattern; none where there is no folder. Only those names reach Python."""
    fs, there = _hadoop(spark, folder)
    fits = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobFilter(pattern)
    return sorted(x.getPath().getName() for x in fs.listStatus(there, fits)) if fs.exists(there) else []


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, there = _hadoop(spark, path)
    data = fs.open(there)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
    finally:
        data.close()
