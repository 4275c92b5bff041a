"""Applying evidence: freezing inputs, guarding against late ones, and merging the change set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.identity import event_id
from faultline.functions.scalars import usable

EXECUTION_KEY = ["check_id", "invocation_id"]
#: What reviewers own; a replay never overwrites it.
PROTECTED = ("workflow_status", "test_status", "call_to_action", "ticket_url", "notes", "owner", "verdict", "version", "annotated_at")


def freeze(executions: DataFrame, receipts: DataFrame, tracked: DataFrame) -> DataFrame:
    """Usable executions of tracked checks without a receipt."""
    return (
        executions.where(usable())
        .join(tracked.select("check_id"), "check_id", "left_semi")
        .join(receipts, EXECUTION_KEY, "left_anti")
        .select(*EXECUTION_KEY, "captured_at")
    )


def in_scope(history: DataFrame, frozen: DataFrame, tracked: DataFrame) -> DataFrame:
    """Active occurrences of checks that have frozen inputs or are tracked no longer."""
    checks = frozen.select("check_id").distinct().withColumn("has_input", F.lit(True))
    known = tracked.select("check_id").withColumn("is_tracked", F.lit(True))
    return (
        history.where("record_status = 'Active'")
        .join(checks, "check_id", "left")
        .join(known, "check_id", "left")
        .where("has_input or is_tracked is null")
        .drop("has_input", "is_tracked")
    )


def affected(history: DataFrame, candidates: DataFrame) -> DataFrame:
    return history.join(candidates.select("check_id", "identity").distinct(), ["check_id", "identity"], "left_semi")


def high_water(executions: DataFrame) -> DataFrame:
    """The last processed execution of each check."""
    last = F.max(F.struct("captured_at", "invocation_id"))
    return executions.groupBy("check_id").agg(last.alias("m")).select("check_id", "m.captured_at", "m.invocation_id")


def late(frozen: DataFrame, state: DataFrame) -> DataFrame:
    """Frozen executions at or before their check's high water."""
    marks = state.select("check_id", F.struct("captured_at", "invocation_id").alias("mark"))
    return frozen.join(marks, "check_id").where(F.struct("captured_at", "invocation_id") <= F.col("mark")).drop("mark")


def refuse_late(frozen: DataFrame, state: DataFrame) -> None:
    found = late(frozen, state).orderBy("captured_at", *EXECUTION_KEY).limit(20).collect()
    if found:
        raise ValueError("late evidence: " + ", ".join(f"{r.check_id}/{r.invocation_id}" for r in found))


def refuse_unskippable(items: DataFrame, executions: DataFrame, receipts: DataFrame, state: DataFrame) -> None:
    """Raise unless every item is given once and is a usable, late execution without a receipt."""
    require_none(repeated_keys(items, EXECUTION_KEY), "an execution is given twice")
    chosen = executions.where(usable()).join(receipts, EXECUTION_KEY, "left_anti")
    require_none(items.join(late(chosen, state), EXECUTION_KEY, "left_anti"), "an execution is unknown, unusable, not late or received already")


def skip_late(items: DataFrame, executions: DataFrame, receipts: DataFrame, state: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events, receipts) that record late, usable and unreceipted executions as skipped."""
    chosen = (
        executions.where(usable())
        .join(items.select(*EXECUTION_KEY).distinct(), EXECUTION_KEY, "left_semi")
        .join(receipts, EXECUTION_KEY, "left_anti")
    )
    found = late(chosen, state)
    kind = F.lit("EVIDENCE_SKIPPED")
    null = F.lit(None).cast("string")
    events = found.select(
        event_id(F.col("check_id"), null, F.col("invocation_id"), kind).alias("event_id"),
        *EXECUTION_KEY,
        now.alias("event_at"),
        kind.alias("event_type"),
    )
    return events, found.select(*EXECUTION_KEY, F.lit("skipped_late").alias("outcome"))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of source whose key the target lacks, one per key: the least of its rows, column by column."""
    rest = [c for c in source.columns if c not in keys]
    fresh = source.join(target.select(*keys), keys, "left_anti").select(*source.columns)
    if not rest:
        return fresh.distinct()
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_one"))
    return one.select(*[F.col(c) if c in keys else F.col("_one")[c].alias(c) for c in source.columns])


def merged(target: DataFrame, changes: DataFrame, key: str = "occurrence_id") -> DataFrame:
    """The next version of target: changed rows replaced but for what reviewers own, new ones added.

    The workflow at close is the target's own at the moment it goes from Active to Archived.
    """
    old, new = target.withColumn("_old", F.lit(True)), changes.withColumn("_new", F.lit(True))
    met = old.alias("o").join(new.alias("n"), key, "full")
    known, changed = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    closes = (F.col("o.record_status") == "Active") & (F.col("n.record_status") == "Archived")
    of = lambda c: F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    own = lambda c: F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    at_close = F.when(closes, F.col("o.workflow_status")).otherwise(own("workflow_at_close"))
    made = {key: F.col(key), "workflow_at_close": at_close.alias("workflow_at_close")} | {c: own(c).alias(c) for c in PROTECTED}
    return met.select(*[made.get(c, of(c).alias(c)) for c in target.columns])


def abandoned(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """runs with started ones older than so many minutes given up."""
    old = (F.col("status") == "started") & (F.col("started_at") < now - F.expr(f"interval {int(minutes)} minutes"))
    return runs.withColumn("status", F.when(old, "abandoned").otherwise(F.col("status")))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def require_none(rows: DataFrame, message: str) -> None:
    if not rows.isEmpty():
        raise ValueError(message)
