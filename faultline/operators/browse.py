"""Browsing: filters, keyset pages that fetch wide rows late, counts and choices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import contains_text, has_tag, owner_of, priority_rank, workflow_of

SEARCHED = ("check_name", "identity", "payload", "workflow_status", "owner", "call_to_action", "notes", "ticket_url", "priority", "tags")
PAGE_SIZES = (25, 50, 100, 200)
#: A page goes back to its rows by broadcast; this bounds what is sent.
MAX_PAGE = 2_000


@dataclass(frozen=True)
class Filters:
    lifecycle: str | None = "Active"
    #: With it, issues archived since then are part of the population of open ones.
    archived_since: datetime | None = None
    statuses: Sequence[str] = ()
    owners: Sequence[str] = ()
    priorities: Sequence[str] = ()
    tags: Sequence[str] = ()
    created_from: datetime | None = None
    created_before: datetime | None = None
    recurrences_only: bool = False
    search: str = ""
    searched: Sequence[str] = field(default=SEARCHED)

    def predicate(self) -> Column:
        parts = [F.lit(True)]
        if self.lifecycle:
            shown = F.col("record_status") == self.lifecycle
            recent = F.col("archived_at") >= F.lit(self.archived_since).cast("timestamp_ntz") if self.archived_since else None
            parts.append(shown if recent is None else shown | F.coalesce(recent, F.lit(False)))
        if self.statuses:
            parts.append(workflow_of(F.col("workflow_status")).isin(*[s.upper() for s in self.statuses]))
        if self.owners:
            parts.append(owner_of(F.col("owner")).isin(*self.owners))
        if self.priorities:
            parts.append(F.coalesce("priority", F.lit("unset")).isin(*self.priorities))
        if self.tags:
            parts.append(has_tag(F.col("tags"), self.tags))
        if self.created_from:
            parts.append(F.col("first_seen_at") >= F.lit(self.created_from).cast("timestamp_ntz"))
        if self.created_before:
            parts.append(F.col("first_seen_at") < F.lit(self.created_before).cast("timestamp_ntz"))
        if self.recurrences_only:
            parts.append(F.col("is_recurrence"))
        if self.search.strip():
            parts.append(contains_text([F.col(c) for c in self.searched], self.search))
        found = parts[0]
        for part in parts[1:]:
            found &= part
        return found


def keys(issues: DataFrame, filters: Filters) -> DataFrame:
    return issues.where(filters.predicate()).select(priority_rank(F.col("priority")).alias("rank"), "first_seen_at", "occurrence_id")


def page_keys(issues: DataFrame, filters: Filters, size: int, after: tuple[int, datetime, str] | None = None) -> DataFrame:
    """The keys of a page and one more, which tells whether another page follows."""
    if not 0 < size <= MAX_PAGE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows")
    found = keys(issues, filters)
    if after:
        rank, seen, last = after
        seen = F.lit(seen).cast("timestamp_ntz")
        same = (F.col("rank") == rank) & ((F.col("first_seen_at") > seen) | ((F.col("first_seen_at") == seen) & (F.col("occurrence_id") > last)))
        found = found.where((F.col("rank") >= rank) & ((F.col("rank") > rank) | same))
    return found.orderBy("rank", "first_seen_at", "occurrence_id").limit(size + 1)


def rows_of(issues: DataFrame, page: DataFrame) -> DataFrame:
    """Whole rows of a page, read after its keys are known; a page is at most MAX_PAGE + 1 keys."""
    return issues.join(F.broadcast(page.select("occurrence_id")), "occurrence_id", "left_semi")


def metrics(issues: DataFrame, filters: Filters) -> DataFrame:
    """Counts over all open issues and how many match, in one pass."""
    active = F.col("record_status") == "Active"
    status = workflow_of(F.col("workflow_status"))
    return issues.agg(
        F.count_if(active).alias("active"),
        F.count_if(active & (status == "NEW")).alias("new"),
        F.count_if(active & (status == "BLOCKED")).alias("blocked"),
        F.count_if(active & (priority_rank(F.col("priority")) <= 1)).alias("urgent"),
        F.count_if(active & F.col("is_recurrence")).alias("recurring"),
        F.count_if(filters.predicate()).alias("matching"),
    )


def synced(issues: DataFrame, filters: Filters, most: int) -> DataFrame:
    """What a local copy holds, newest first, and one more, which tells that the copy is not whole."""
    return issues.where(filters.predicate()).orderBy(F.col("first_seen_at").desc(), "occurrence_id").limit(most + 1)


def options(issues: DataFrame, most: int = 500) -> DataFrame:
    """Choices of the filters: (kind, value), the first so many of each kind.

    Each kind's choices are a top-k of distinct values, so none is gathered whole.
    """
    active = issues.where("record_status = 'Active'")
    tags = active.select(F.explode(F.from_json("tags", "array<string>")).alias("value")).select(F.trim("value").alias("value")).where("value <> 'dqm'")
    kinds = {"owner": active.select(owner_of(F.col("owner")).alias("value")), "status": active.select(workflow_of(F.col("workflow_status")).alias("value")), "tag": tags}
    found = [rows.where("value <> ''").distinct().orderBy("value").limit(most).select(F.lit(kind).alias("kind"), "value") for kind, rows in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])
