"""Retention: what may go, by receipts and by age, and the runner of maintenance steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EXECUTION = ["check_id", "invocation_id"]


def prunable(executions: DataFrame, receipts: DataFrame, started_inputs: DataFrame, cutoff: Column) -> DataFrame:
    """Old executions with a receipt that no started run still needs."""
    return (
        executions.where(F.col("captured_at") < cutoff)
        .join(receipts.select(*_EXECUTION), _EXECUTION, "left_semi")
        .join(started_inputs.select(*_EXECUTION), _EXECUTION, "left_anti")
        .select(*_EXECUTION)
    )


def without(rows: DataFrame, gone: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.join(gone, keys or _EXECUTION, "left_anti")


def kept_since(rows: DataFrame, column: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(column) >= cutoff)


def advanced(before: Column, cutoff: Column) -> Column:
    """The prune mark never goes back."""
    return F.greatest(F.coalesce(before, cutoff), cutoff)


def cached_pages(pages: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """The most recently used pages that fit both bounds; pages: page_id, used_at, n_rows, n_bytes."""
    w = Window.orderBy(F.col("used_at").desc(), "page_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = pages.withColumn("rows_so_far", F.sum("n_rows").over(w)).withColumn("bytes_so_far", F.sum("n_bytes").over(w))
    return counted.where((F.col("rows_so_far") <= max_rows) & (F.col("bytes_so_far") <= max_bytes))


def run_steps(steps: Mapping[str, Callable[[], None]], log: Callable[[dict], None], strict: bool = False) -> dict[str, str]:
    """Run each step on its own; a failure is logged under an id and never stops the others.

    strict: afterwards raise unless every step has succeeded.
    """
    outcomes = {}
    for name, step in steps.items():
        row = {"step": name, "outcome": "succeeded", "diagnostic_id": None}
        try:
            step()
        except Exception as error:  # a step's failure is an outcome
            row |= {"outcome": "failed", "diagnostic_id": uuid.uuid4().hex, "error": type(error).__name__}
        log(row)
        outcomes[name] = row["outcome"]
    if strict and any(o != "succeeded" for o in outcomes.values()):
        raise RuntimeError("maintenance failed: " + ", ".join(n for n, o in outcomes.items() if o != "succeeded"))
    return outcomes
