"""Capture as one step: a check runs, its sample is staged once, and one commit records the outcome."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.identity import grain_of
from faultline.functions.scalars import owner_text
from faultline.operators import capture
from faultline.operators.reconcile import shaped
from faultline.plans.checks import Check
from faultline.sources.scratch import kept
from faultline.sources.store import Ledger, Stale


def collect(
    ledger: Ledger,
    check: Check,
    invocation_id: str,
    captured_at: Column,
    reported: int | None = None,
    project_owner: str | None = None,
    empty_source: bool = False,
) -> str:
    """The collection status of one run of a check, recorded with its observations.

    reported: how many failures the runner counted; a staged copy that differs is a
    collection error, and then nothing of it counts as observed.  A check that can't
    be tracked is a configuration error, and its rows are not read.  The owner is the
    row's, else the check's, else the project's.
    """
    spark = ledger.spark
    rows = check.failing(spark)
    problems = check.problems(rows.columns)
    found, status = None, "configuration_error"
    figures = {"failure_count": reported, "owner_conflicts": 0}
    if not problems:
        grain = grain_of(check.grain)
        staged = kept(capture.bounded_sample(rows, grain, check.limit), "staged")
        found = kept(capture.observations(staged, capture.row_owner(staged, check.owner_column), owner_text(check.owner) or owner_text(project_owner)), "observed")
        stats = capture.capture_stats(found).first()
        raw = staged.count()
        limit = F.lit(check.limit).cast("long")
        at = capture.collection_status(F.lit(raw), F.lit(raw if reported is None else reported), limit, F.lit(empty_source))
        status = spark.range(1).select(at).first()[0]
        figures = {"failure_count": raw, "owner_conflicts": stats.owner_conflicts}
    result = "pass" if not figures["failure_count"] else "warn" if check.severity == "warn" else "fail"
    texts = {
        "check_id": check.check_id, "invocation_id": invocation_id, "status": status, "result": result if not problems else "error",
        "scheme": None if problems else check.scheme, "granularity": None if problems else check.granularity,
        "priority": None if check.priority in (None, "unset") else str(check.priority).strip().lower(), "criticality": check.criticality,
        "tags": json.dumps(list(check.tags), separators=(",", ":")), "check_name": check.name or check.check_id, "severity": check.severity,
        "source_id": check.depends_on[0] if len(check.depends_on) == 1 else None,
    }
    literals = [F.lit(v).cast("string").alias(k) for k, v in texts.items()] + [F.lit(v).cast("long").alias(k) for k, v in figures.items()]
    execution = shaped(spark.range(1).select(*literals, captured_at.alias("captured_at"), F.lit(check.limit).cast("long").alias("failure_limit")), "executions")
    appended = {"executions": execution}
    if found is not None and status != "collection_error":
        named = [F.lit(texts[c]).cast("string").alias(c) for c in ("check_id", "invocation_id", "scheme")]
        appended["observations"] = shaped(found.select("*", *named, F.lit(check.call_to_action).cast("string").alias("call_to_action")), "observations")
    while True:
        try:
            ledger.commit(ledger.manifest(), append=appended)
            return status
        except Stale:
            continue
