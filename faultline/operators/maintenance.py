"""Maintenance of a ledger: pruning, retention and checked snapshots, each as one commit."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import apply, retention
from faultline.operators.reconcile import shaped
from faultline.sources.store import Ledger


def _instant(at: datetime):
    return F.lit(at).cast("timestamp_ntz")


def prune_raw(ledger: Ledger, cutoff: datetime) -> dict:
    """Old evidence with a receipt goes; the prune mark only moves forward, and frozen runs are fenced off."""
    base = ledger.manifest()
    read = lambda table: ledger.read(table, base)
    started = read("inputs").join(read("runs").where("status = 'started'").select("run_id"), "run_id", "left_semi")
    gone = retention.prunable(read("executions"), read("receipts"), started, _instant(cutoff))
    left = {t: shaped(retention.without(read(t), gone), t) for t in ("executions", "observations")}
    mark = max(filter(None, (base["raw_pruned_before"], cutoff.isoformat())))
    return ledger.commit(base, replace=left, new_generation=True, raw_pruned_before=mark)


def keep_since(ledger: Ledger, cutoffs: Mapping[str, tuple[str, datetime]]) -> dict:
    """Drop rows of tables that are older than their cutoff; table: (time column, cutoff).  Started runs stay."""
    base = ledger.manifest()
    left = {}
    for table, (column, cutoff) in cutoffs.items():
        rows = ledger.read(table, base)
        young = F.col(column) >= _instant(cutoff)
        left[table] = shaped(rows.where(young | (F.col("status") == "started") if table == "runs" else young), table)
    return ledger.commit(base, replace=left)


def skip_late(ledger: Ledger, items: DataFrame, now) -> dict:
    """Record late executions as skipped; all of them or none."""
    base = ledger.manifest()
    executions, receipts, state = (ledger.read(t, base) for t in ("executions", "receipts", "state"))
    apply.refuse_unskippable(items, executions, receipts, state)
    events, made = apply.skip_late(items, executions, receipts, state, now)
    known = made.join(executions.select("check_id", "invocation_id", "captured_at"), ["check_id", "invocation_id"]).withColumn("recorded_at", now)
    return ledger.commit(base, append={"events": shaped(events, "events"), "receipts": shaped(known, "receipts")}, new_generation=True)


def verified_snapshot(ledger: Ledger) -> tuple[DataFrame, dict]:
    """Occurrences of one version and its manifest; raises if a row lacks an identity or a record, or an id is there twice."""
    frames, manifest = ledger.snapshot("occurrences")
    rows = frames["occurrences"]
    fields = F.size(F.map_keys(F.from_json("payload", "map<string,string>")))
    bad = rows.where(F.col("identity").isNull() | (F.coalesce(fields, F.lit(0)) <= 0))
    apply.require_none(bad, "an occurrence lacks its identity or its record")
    apply.require_none(apply.repeated_keys(rows, ["occurrence_id"]), "an occurrence is there twice")
    return rows, manifest


def write_metrics(metrics: Mapping[str, object], path: str) -> None:
    """A run's figures as one JSON file, with names in order, for whoever watches the runs."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(dict(metrics), out, indent=1, sort_keys=True, default=str)
        out.write("\n")
