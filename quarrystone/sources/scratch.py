"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables of this process that haven't been discarded.
_TABLES: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local runs without it a temporary folder that goes when Python ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarrystone-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when it is discarded, or when Python ends."""
    if not _TABLES:
        atexit.unregister(_clear)
        atexit.register(_clear)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _TABLES.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lost executors lose nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_paths = (path,)
    return out


def on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, marked as read from written tables, so that discarding it discards them."""
    df.scratch_paths = tuple(p for t in tables for p in t.scratch_paths)
    return df


def discard(*frames: DataFrame) -> None:
    """Remove written tables that nothing will read any more."""
    for path in {p for f in frames for p in getattr(f, "scratch_paths", ())} & _TABLES:
        _remove(path)
        _TABLES.discard(path)


def _remove(path: str) -> None:
    jvm = SparkContext._jvm
    context = SparkContext._active_spark_context
    conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _clear() -> None:
    for path in _TABLES:
        with contextlib.suppress(Exception):  # the session and its JVM may be gone
            _remove(path)
