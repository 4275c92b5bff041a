"""Exports: records as columns, and CSV that a spreadsheet opens safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import formula_guarded

MAX_ROWS = 50_000


def record() -> Column:
    """The payload's top-level fields; a name that is there twice is an error.

    Capture writes every value as text, so it comes back unchanged; a bare number of
    other origin is shown as Spark prints it.
    """
    names = F.json_object_keys("payload")
    once = F.size(names) == F.size(F.array_distinct(names))
    failed = F.raise_error(F.concat(F.lit("a record has a field twice: "), "occurrence_id")).cast("map<string,string>")
    return F.when(F.coalesce(once, F.lit(True)), F.from_json("payload", "map<string,string>")).otherwise(failed)


def record_fields(issues: DataFrame) -> DataFrame:
    """(occurrence_id, field, value): the top-level fields of each payload as text."""
    parsed = record()
    return issues.select("occurrence_id", F.explode(parsed).alias("field", "value"))


def expanded(issues: DataFrame, fields: list[str]) -> DataFrame:
    """issues with the named payload fields as columns ``record.<field>``; one scan, no pivot."""
    parsed = record()
    return issues.withColumn("_p", parsed).select(*issues.columns, *[F.element_at("_p", F.lit(f)).alias(f"record.{f}") for f in fields])


def field_names(issues: DataFrame) -> list[str]:
    """Names of the payload fields; their number is that of the checks' columns."""
    return [r[0] for r in record_fields(issues).select("field").distinct().orderBy("field").collect()]


def csv_rows(issues: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of an export in order, as guarded text, one more than the cap to tell that there are more."""
    chosen = issues.orderBy("first_seen_at", "occurrence_id").limit(MAX_ROWS + 1)
    return chosen.select(*[formula_guarded(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str) -> int:
    """One UTF-8 file with a byte order mark, for spreadsheets; rows are capped, so one writer is enough."""
    found = rows.limit(MAX_ROWS + 1).toPandas()
    if len(found) > MAX_ROWS:
        raise ValueError(f"an export holds {MAX_ROWS} rows at most")
    found.to_csv(path, index=False, encoding="utf-8-sig")
    return len(found)
