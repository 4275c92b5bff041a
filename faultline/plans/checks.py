"""Checks: what is tracked, and how a failing row is known again."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from faultline.functions.identity import grain_of, granularity_signature, scheme_signature
from faultline.functions.scalars import PRIORITIES, owner_text


@dataclass(frozen=True)
class Check:
    check_id: str
    rows: Callable[[SparkSession], DataFrame] | str
    grain: tuple[str, ...]
    name: str = ""
    priority: str | None = None
    criticality: str | None = None
    owner: str | list | None = None
    call_to_action: str | None = None
    tags: tuple[str, ...] = ()
    severity: str = "error"
    limit: int | None = 100
    depends_on: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    owner_column: str = "row_owner"

    def failing(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.rows) if isinstance(self.rows, str) else self.rows(spark)

    @property
    def scheme(self) -> str:
        return scheme_signature(self.grain)

    @property
    def granularity(self) -> str:
        return granularity_signature(self.grain)

    def problems(self, columns: Iterable[str] | None = None) -> list[str]:
        """Why this check can't be tracked; empty if it can."""
        found = []
        try:
            grain = grain_of(self.grain)
        except (ValueError, TypeError) as error:
            return [str(error)]
        if columns is not None:
            low = [c.lower() for c in columns]
            found += [f"grain column {g!r} must match exactly one output column" for g in grain if low.count(g) != 1]
            if low.count(self.owner_column.lower()) > 1:
                found.append("at most one output column may name the row's owner")
        if self.priority is not None and str(self.priority).strip().lower() not in (*PRIORITIES, "unset"):
            found.append(f"priority must be one of {', '.join(PRIORITIES)} or unset")
        if self.criticality is not None and not isinstance(self.criticality, str):
            found.append("criticality must be text")
        if self.limit is not None and (isinstance(self.limit, bool) or not isinstance(self.limit, int) or self.limit < 1):
            found.append("the limit must be a positive integer")
        if self.settings.get("fail_calc", "count(*)") != "count(*)":
            found.append("failures must be counted by count(*)")
        if self.settings.get("storage", "table") != "table":
            found.append("failures must be stored as a table")
        if {"owner", self.owner_column} & self.settings.keys():
            found.append("the owner belongs to the check, not to its settings")
        found += [f"unknown setting {k!r}" for k in sorted(self.settings.keys() - {"fail_calc", "storage", "owner", self.owner_column})]
        try:
            owner_text(self.owner)
        except ValueError as error:
            found.append(str(error))
        return found


class Registry:
    """All tracked checks.  A selection decides what runs and never what is tracked."""

    def __init__(self, checks: Iterable[Check]):
        self.checks = {c.check_id: c for c in checks}

    def select(self, include: Iterable[str] | None = None, exclude: Iterable[str] = ()) -> list[Check]:
        gone = set(exclude)
        return [self.checks[i] for i in (include or self.checks) if i in self.checks and i not in gone]

    def tracked(self, spark: SparkSession) -> DataFrame:
        rows = [(c.check_id, c.name or c.check_id, c.severity, c.priority) for c in self.checks.values()]
        return spark.createDataFrame(rows, "check_id string, check_name string, severity string, priority string")


#: Results from the worst to the best.
RESULT_ORDER = ("error", "fail", "warn", "skipped", "pass")


def by_outcome(results: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(result, name) by the gravity of the result, then by name."""
    return sorted(results, key=lambda r: (RESULT_ORDER.index(r[0]) if r[0] in RESULT_ORDER else -1, r[1]))
