"""Record payloads: every column of a failing row as one JSON object of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAP = "map<string,string>"


def value_text(value: Column, kind: T.DataType) -> Column:
    """A column value as text: nested values as JSON, bytes as base64, others cast."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    return value.cast("string")


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """An ordered JSON object of texts that keeps nulls."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in pairs]), {"ignoreNullFields": "false"})


def record_payload(rows: DataFrame, columns: list[str] | None = None) -> Column:
    names = columns or rows.columns
    return json_object([(c, value_text(F.col(f"`{c}`"), rows.schema[c].dataType)) for c in names])


def changed_keys(before: Column, after: Column) -> Column:
    """Sorted names of the top-level keys that differ, comma-joined; null when none does."""
    m, n = F.from_json(before, _MAP), F.from_json(after, _MAP)
    empty = F.array().cast("array<string>")
    keys = F.array_union(F.coalesce(F.map_keys(m), empty), F.coalesce(F.map_keys(n), empty))
    held = lambda x, k: F.coalesce(F.map_contains_key(x, k), F.lit(False))
    differs = lambda k: (held(m, k) != held(n, k)) | ~F.element_at(m, k).eqNullSafe(F.element_at(n, k))
    changed = F.filter(keys, differs)
    return F.when(F.size(changed) > 0, F.array_join(F.array_sort(changed), ","))


def payload_changed(before: Column, after: Column) -> Column:
    """Whether payloads differ in a value; another order of the same keys is no change."""
    return (
        F.when(before.eqNullSafe(after), F.lit(False))
        .when(before.isNull() | after.isNull(), F.lit(True))
        .otherwise(changed_keys(before, after).isNotNull())
    )
