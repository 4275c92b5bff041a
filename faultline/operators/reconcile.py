"""Guarded reconciliation: freeze, late guard, replay, merge, events, receipts and high water in one commit.

A run first records what it will process (``freeze``) and then applies it.  The
apply is one new version of the ledger: it is refused if the evidence has moved on
since the freeze, and made again on top of reviewers' edits that came between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import apply, replay
from faultline.sources.scratch import kept
from faultline.sources.store import Ledger, Stale

_EXECUTION = "check_id string, invocation_id string"
TABLES = {
    "executions": f"{_EXECUTION}, captured_at timestamp_ntz, status string, result string, scheme string, priority string, tags string,"
    " check_name string, source_id string, source_name string, severity string, granularity string, criticality string,"
    " failure_count long, owner_conflicts long, failure_limit long",
    "observations": f"{_EXECUTION}, identity string, scheme string, payload string, row_count long, owner string, call_to_action string",
    "occurrences": replay.OCCURRENCE,
    "events": "event_id string, check_id string, occurrence_id string, identity string, invocation_id string, event_at timestamp_ntz,"
    " event_type string, previous_payload string, payload string, reason string, payload_mode string, changed_columns string,"
    " previous_digest string, digest string",
    "receipts": f"{_EXECUTION}, captured_at timestamp_ntz, run_id string, outcome string, recorded_at timestamp_ntz",
    "state": "check_id string, captured_at timestamp_ntz, invocation_id string",
    "runs": "run_id string, status string, generation_at_freeze long, started_at timestamp_ntz, completed_at timestamp_ntz",
    "inputs": f"run_id string, {_EXECUTION}, captured_at timestamp_ntz",
    "changes": "batch_id string, occurrence_id string, field_name string, old_value string, new_value string, from_version int, to_version int, changed_at timestamp_ntz",
    "missed": "missed_id string, title string, root_cause string, discovered_at timestamp_ntz, source_id string, area_label string, check_id string",
    "log": "logged_at timestamp_ntz, invocation_id string, step string, outcome string, trigger_marker_at timestamp_ntz, trigger_kind string, diagnostic_id string",
}
#: What names a row of each table.
KEYS = {
    "executions": ["check_id", "invocation_id"], "observations": ["check_id", "invocation_id", "identity"], "occurrences": ["occurrence_id"],
    "events": ["event_id"], "receipts": ["check_id", "invocation_id"], "state": ["check_id"], "runs": ["run_id"],
    "inputs": ["run_id", "check_id", "invocation_id"], "changes": ["batch_id", "occurrence_id", "field_name"], "missed": ["missed_id"],
}


def shaped(rows: DataFrame, table: str) -> DataFrame:
    """rows with the columns of a table; those that are missing are null."""
    schema = rows.sparkSession.createDataFrame([], TABLES[table]).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def freeze(ledger: Ledger, tracked: DataFrame, run_id: str, now: Column) -> dict:
    """Record a started run and exactly which executions it may apply."""
    base = ledger.manifest()
    if not ledger.read("runs", base).where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"the run {run_id} is known already")
    found = apply.freeze(ledger.read("executions", base), ledger.read("receipts", base), tracked)
    apply.refuse_late(found, ledger.read("state", base))
    row = ledger.spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit("started").alias("status"), F.lit(base["generation"]).alias("generation_at_freeze"), now.alias("started_at")
    )
    return ledger.commit(base, append={"inputs": shaped(found.withColumn("run_id", F.lit(run_id)), "inputs"), "runs": shaped(row, "runs")})


def change_set(ledger: Ledger, frozen: dict, tracked: DataFrame, run_id: str, now: Column, payload_mode: str = "full") -> tuple[DataFrame, DataFrame]:
    """(changed and new occurrences, events) that the frozen inputs of a run make; nothing is written to the ledger."""
    inputs = ledger.read("inputs", frozen).where(F.col("run_id") == run_id)
    mine = lambda table: ledger.read(table, frozen).join(inputs.select("check_id", "invocation_id"), ["check_id", "invocation_id"], "left_semi")
    executions, observations, every = mine("executions"), mine("observations"), ledger.read("occurrences", frozen)
    open_ = apply.in_scope(every, inputs, tracked)
    history = kept(apply.affected(every, replay.candidates(observations, open_)), "reconcile-history")
    states = replay.states(executions, observations, history, only_considered=True)
    changed = kept(replay.occurrences(states, history), "reconcile-changes")
    closed, closings = replay.removed_checks(every, tracked, now, run_id)
    events = replay.lifecycle_events(states, changed, history).unionByName(closings)
    return changed.drop("episode").unionByName(closed), shaped(replay.event_payloads(events, payload_mode), "events")


def reconcile(ledger: Ledger, tracked: DataFrame, run_id: str, now: Column, payload_mode: str = "full") -> dict:
    """One run from freeze to commit; the manifest of the version that it makes."""
    frozen = freeze(ledger, tracked, run_id, now)
    try:
        changes, events = change_set(ledger, frozen, tracked, run_id, now, payload_mode)
        inputs = ledger.read("inputs", frozen).where(F.col("run_id") == run_id)
        receipts = inputs.withColumn("outcome", F.lit("applied")).withColumn("recorded_at", now)

        def version(current: dict) -> dict:
            read = lambda table: ledger.read(table, current)
            marks = read("state").unionByName(inputs.select("check_id", "captured_at", "invocation_id"))
            ended = F.when(F.col("run_id") == run_id, "completed").otherwise(F.col("status"))
            runs = read("runs").withColumn("completed_at", F.when(F.col("run_id") == run_id, now).otherwise(F.col("completed_at"))).withColumn("status", ended)
            return {
                "replace": {
                    "occurrences": shaped(apply.merged(read("occurrences"), changes), "occurrences"),
                    "state": shaped(apply.high_water(marks), "state"),
                    "runs": shaped(runs, "runs"),
                },
                "append": {
                    "events": shaped(apply.insert_new(read("events"), events, ["event_id"]), "events"),
                    "receipts": shaped(receipts, "receipts"),
                },
            }

        return ledger.rebased(frozen, version, new_generation=True)
    except BaseException:
        abandon(ledger, run_id)
        raise


def abandon(ledger: Ledger, run_id: str) -> None:
    """Give up a started run, so that it holds nothing back."""
    while True:
        base = ledger.manifest()
        gone = (F.col("run_id") == run_id) & (F.col("status") == "started")
        runs = ledger.read("runs", base).withColumn("status", F.when(gone, "abandoned").otherwise(F.col("status")))
        try:
            ledger.commit(base, replace={"runs": shaped(runs, "runs")})
            return
        except Stale:
            continue
