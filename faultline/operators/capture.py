"""Capture: a bounded sample of failing rows becomes observations and one execution row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.identity import identity_hash, normalised
from faultline.functions.payload import json_object, record_payload


def _named(rows: DataFrame, name: str) -> str:
    return next(c for c in rows.columns if c.lower() == name)


def identity_of(rows: DataFrame, grain: list[str]) -> Column:
    return identity_hash({g: normalised(F.col(f"`{_named(rows, g)}`")) for g in grain})


def bounded_sample(rows: DataFrame, grain: list[str], limit: int | None) -> DataFrame:
    """The first rows by identity, then by whole row: one top-k, no full sort."""
    found = rows.withColumn("identity", identity_of(rows, grain)).withColumn("payload", record_payload(rows))
    return found if limit is None else found.orderBy("identity", "payload").limit(limit)


def observations(sample: DataFrame, row_owner: Column | None = None, check_owner: str | None = None) -> DataFrame:
    """One row per identity: rows collapsed, the least payload, and an owner.

    The row's owner wins unless rows of one identity disagree; then, and where
    none is named, the check's owner does.
    """
    own = F.nullif(F.trim(row_owner.cast("string")), F.lit("")) if row_owner is not None else F.lit(None).cast("string")
    return (
        sample.select("identity", "payload", own.alias("row_owner"))
        .groupBy("identity")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("payload").alias("payload"),
            F.min("row_owner").alias("low"),
            F.max("row_owner").alias("high"),
        )
        .select(
            "identity",
            "row_count",
            "payload",
            F.when(F.col("low") != F.col("high"), F.lit(check_owner)).otherwise(F.coalesce("low", F.lit(check_owner))).alias("owner"),
            F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("owner_conflict"),
        )
    )


def row_owner(rows: DataFrame, name: str) -> Column | None:
    """The column that names a row's owner, in any case; None without one."""
    found = [c for c in rows.columns if c.lower() == name.lower()]
    if len(found) > 1:
        raise ValueError(f"at most one column may be called {name}")
    return F.col(f"`{found[0]}`") if found else None


def collection_status(raw_rows: Column, reported: Column, limit: Column, empty_source: Column) -> Column:
    """What one staged copy says about itself; rows that differ from the reported count are an error."""
    return (
        F.when(raw_rows != reported, "collection_error")
        .when((raw_rows == 0) & empty_source, "not_applicable")
        .when(limit.isNotNull() & (raw_rows >= limit), "limit_reached")
        .otherwise("success")
    )


def capture_stats(found: DataFrame) -> DataFrame:
    """Raw rows, identities and owner conflicts of one capture, in one pass."""
    return found.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("issues"),
        F.count_if("owner_conflict").alias("owner_conflicts"),
    )


def grain_pairs(rows: DataFrame, grain: list[str]) -> Column:
    return json_object([(g, normalised(F.col(f"`{_named(rows, g)}`"))) for g in grain])
