"""Shared plumbing of the text operators: tables, scratch storage, row keys.

Scratch tables are Parquet files below ``spark.checkpoint.dir``.  They cut
lineage and survive the loss of an executor, since every node sees that folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.scratch import scratch_path

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id inside joins; it sorts below every real id.
NULL_ID = -(2**63)

_SETTINGS = {
    # whole texts travel to Python in small batches, so that memory follows the batch and not the table
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Set what Python stages need, and ship this package to the executors once per application.

    The settings stay: frames are returned before they run, and it is then that batches are made.
    """
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="faultline-code-")
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/faultline.zip", "w") as archive:
            for path in (root / "faultline").rglob("*.py"):
                archive.write(path, path.relative_to(root))
        spark.sparkContext.addPyFile(f"{folder}/faultline.zip")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are dropped as soon as it has ended."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


_scopes: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables kept inside are removed at its end, but for those that stay.

    What is used later must not be read from the others: keep it, with ``stays``.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write df to a scratch table and read it back: a recoverable cut in the lineage."""
    spark = tune(df.sparkSession)
    path = scratch_path(spark, name)
    if len(_scopes) > stays:  # what stays belongs to the scope around
        _scopes[-1 - stays].append(path)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() does it where the text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def id_key(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that tell rows apart: the id, and a hash of the text for ids that repeat."""
    return [id_key(doc_id).alias("_d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h")]
