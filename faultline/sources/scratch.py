"""Intermediate tables that are read more than once, written where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it names none, a folder of our own, but only if all runs on this machine.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="faultline-")
    atexit.register(shutil.rmtree, base, True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    return path


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows as written and read back: a cut in the lineage that survives a lost executor."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def changed_at(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Name, length and time of each file of a table."""
    at, files = _path(spark, path)
    return tuple(sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in files.listStatus(at)))
