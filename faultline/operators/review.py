"""Reviewer edits: checked, audited and applied only to the version they were made on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields a reviewer may edit.
FIELDS = ("workflow_status", "call_to_action", "ticket_url", "notes", "owner", "verdict")
# fixed values: what a review can say
VERDICTS = ("UNREVIEWED", "TRUE_POSITIVE", "FALSE_POSITIVE")
# fixed values: reasons for an issue that no check found
ROOT_CAUSES = ("no_test", "test_logic_gap", "threshold_too_loose", "test_not_run", "other")


@dataclass(frozen=True)
class Patch:
    occurrence_id: str
    field_name: str
    new_value: str | None
    base_version: int


def validated(patches: Iterable[Patch]) -> list[Patch]:
    """At most one patch for each occurrence and field, and one base version for each occurrence."""
    found = sorted(patches, key=lambda p: (p.occurrence_id, p.field_name))
    seen, versions = set(), {}
    for p in found:
        if p.field_name not in FIELDS:
            raise ValueError(f"{p.field_name!r} can't be edited")
        if p.field_name == "verdict" and p.new_value not in VERDICTS:
            raise ValueError(f"unknown verdict {p.new_value!r}")
        if (p.occurrence_id, p.field_name) in seen:
            raise ValueError("an occurrence has two edits of one field")
        if versions.setdefault(p.occurrence_id, p.base_version) != p.base_version:
            raise ValueError("an occurrence has edits of different versions")
        seen.add((p.occurrence_id, p.field_name))
    return found


def batch_id(patches: Iterable[Patch]) -> str:
    """The same edits always have the same id, so a batch sent twice counts once."""
    text = json.dumps([[p.occurrence_id, p.field_name, p.new_value, p.base_version] for p in validated(patches)], separators=(",", ":"))
    return str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(text.encode()).hexdigest()))


def conflicts(occurrences: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches whose occurrence is unknown or has moved on from their base version."""
    now = occurrences.select("occurrence_id", F.col("version").alias("current_version"))
    return patches.join(now, "occurrence_id", "left").where(~F.col("base_version").eqNullSafe(F.col("current_version")))


def refuse_partial(audit: DataFrame, batch: str, patches: int) -> bool:
    """Whether the batch has been applied; raises if only a part of it has."""
    found = audit.where(F.col("batch_id") == batch).count()
    if found not in (0, patches):
        raise RuntimeError(f"batch {batch} has {found} of {patches} audit rows")
    return found > 0


def applied(occurrences: DataFrame, patches: DataFrame, batch: str, now: Column, audited: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the next version of occurrences, audit rows).

    patches: occurrence_id, field_name, new_value, base_version.  The old values
    of the audit are the ledger's own, not what the reviewer believed.  A workflow
    status is also the test's status.  audited: the audit so far; patches that it
    holds under this batch are applied already and do nothing.
    """
    if audited is not None:
        done = audited.where(F.col("batch_id") == batch).select("occurrence_id", "field_name")
        patches = patches.join(done, ["occurrence_id", "field_name"], "left_anti")
    per = patches.groupBy("occurrence_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "new_value"))).alias("_edits"), F.max("base_version").alias("_base")
    )
    met = occurrences.join(per, "occurrence_id", "left")
    hit = F.col("_base").eqNullSafe(F.col("version")) & F.col("_edits").isNotNull()
    known = [c for c in FIELDS if c in occurrences.columns]

    def edited(c: str, of: str | None = None) -> Column:
        name = F.lit(of or c)
        return F.when(hit & F.map_contains_key("_edits", name), F.element_at("_edits", name)).otherwise(F.col(c)).alias(c)

    made = {c: edited(c) for c in known} | {
        "test_status": edited("test_status", "workflow_status") if "test_status" in occurrences.columns else None,
        "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        "annotated_at": F.when(hit, now).otherwise(F.col("annotated_at")).alias("annotated_at") if "annotated_at" in occurrences.columns else None,
    }
    after = met.select(*[F.col(c) if made.get(c) is None else made[c] for c in occurrences.columns])
    old = F.lit(None).cast("string")
    for name in known:
        old = F.when(F.col("field_name") == name, F.col(name)).otherwise(old)
    audit = (
        patches.join(occurrences.select("occurrence_id", "version", *known), "occurrence_id")
        .where("base_version = version")
        .select(
            F.lit(batch).alias("batch_id"), "occurrence_id", "field_name", old.alias("old_value"), "new_value",
            F.col("version").alias("from_version"), (F.col("version") + 1).alias("to_version"), now.alias("changed_at"),
        )
    )
    return after, audit


def drift(pending: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Pending edits whose base value or version the ledger no longer holds.

    pending: occurrence_id, field_name, base_value, base_version.
    """
    each = occurrences.select("occurrence_id", "version", F.explode(F.create_map(*[x for c in FIELDS if c in occurrences.columns for x in (F.lit(c), F.col(c))])).alias("field_name", "current_value"))
    return (
        pending.join(each, ["occurrence_id", "field_name"])
        .where(~F.col("base_value").eqNullSafe(F.col("current_value")) | ~F.col("base_version").eqNullSafe(F.col("version")))
        .select("occurrence_id", "field_name", "base_value", "current_value", "base_version", F.col("version").alias("current_version"))
    )


def missed_issue(missed_id: str, title: str, root_cause: str, discovered_at: str, source_id: str | None = None, area_label: str | None = None) -> dict:
    if not missed_id.strip() or not title.strip():
        raise ValueError("a missed issue needs an id and a title")
    if root_cause not in ROOT_CAUSES:
        raise ValueError(f"unknown root cause {root_cause!r}")
    if (source_id is None) == (area_label is None):
        raise ValueError("name either the source or the area")
    return {"missed_id": missed_id, "title": title, "root_cause": root_cause, "discovered_at": discovered_at, "source_id": source_id, "area_label": area_label}
