"""Seed files: CSV with a header, read with the types that the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file; a header that differs from the schema and values of other types are errors."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False, nullValue="")
