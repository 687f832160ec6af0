"""Intermediate tables in the folder that all executors share: lineage ends there, a lost executor costs nothing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = re.compile(r"local(\[.*\])?")
_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder if all runs on this machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not _LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="slate-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def fresh_path(spark: SparkSession) -> str:
    """A path in the application's part of the shared folder that nothing uses yet."""
    folder = f"{shared_dir(spark).rstrip('/')}/slate-{spark.sparkContext.applicationId}"
    _FOLDERS[folder] = spark
    return f"{folder}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. It stays until ``discard`` or the application's end."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*saved: DataFrame) -> None:
    """Delete saved tables that no plan will read again."""
    for df in saved:
        _delete(df.sparkSession, df.saved_at)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application saved; results that still read one are lost."""
    for folder in [f for f, s in _FOLDERS.items() if s.sparkContext.applicationId == spark.sparkContext.applicationId]:
        _delete(spark, folder)
        del _FOLDERS[folder]


@atexit.register
def _clear_all() -> None:
    for spark in list(_FOLDERS.values()):
        if spark.sparkContext._jsc is not None:
            clear(spark)
