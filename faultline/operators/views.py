"""Views over the ledger.  ``now`` is always given, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import conclusive, flags, hours_between, owner_of, safe_rate, usable

_EXECUTION = ["check_id", "invocation_id"]


def history(occurrences: DataFrame, active_only: bool = False) -> DataFrame:
    """Occurrences with what the one before them says."""
    key = ["check_id", "identity", "scheme"]
    prev = occurrences.select(
        *[F.col(c).alias(f"_{c}") for c in key],
        (F.col("number") + 1).alias("_number"),
        *[F.col(c).alias(f"previous_{c}") for c in ("occurrence_id", "archived_at", "close_reason", "workflow_at_close", "verdict", "owner")],
    )
    cur = occurrences.where("record_status = 'Active'") if active_only else occurrences
    same = F.col("number") == F.col("_number")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    passed = F.col("previous_close_reason") == "Passed"
    return (
        cur.join(prev, same, "left")
        .drop("_number", *[f"_{c}" for c in key])
        .withColumn("has_previous", F.col("previous_occurrence_id").isNotNull())
        .withColumn("is_recurrence", F.coalesce(passed, F.lit(False)))
        .withColumn("is_potential_regression", F.coalesce(passed & (F.col("previous_workflow_at_close") == "RESOLVED"), F.lit(False)))
    )


def timeline(occurrences: DataFrame) -> DataFrame:
    return occurrences.select(
        "occurrence_id", "check_id", "identity", "scheme", "number",
        F.col("first_seen_at").alias("valid_from"), F.col("archived_at").alias("valid_to"), "close_reason",
        (F.col("record_status") == "Active").alias("is_current"), "payload",
    )


def check_health(
    tracked: DataFrame,
    occurrences: DataFrame,
    executions: DataFrame,
    receipts: DataFrame,
    events: DataFrame,
    missed: DataFrame,
    now: Column,
    raw_pruned_before: Column,
    window_days: int = 30,
    stale_days: int = 14,
) -> DataFrame:
    """One row per tracked check: review, backlog, closures, evidence, rates and attention flags.

    Every input is aggregated to the check before the joins, so the joins are as small as the registry.
    """
    since = now - F.expr(f"interval {int(window_days)} days")
    stale = now - F.expr(f"interval {int(stale_days)} days")
    recent = F.col("first_seen_at") >= since
    active = F.col("record_status") == "Active"
    passed = (F.col("close_reason") == "Passed") & (F.col("archived_at") >= since)
    own = history(occurrences).groupBy("check_id").agg(
        F.count_if(recent).alias("review_population_count"),
        F.count_if(recent & (F.col("verdict") == "TRUE_POSITIVE")).alias("tp_count"),
        F.count_if(recent & (F.col("verdict") == "FALSE_POSITIVE")).alias("fp_count"),
        F.count_if(active).alias("active_issues"),
        F.avg(F.when(active, hours_between(F.col("first_seen_at"), now) / 24.0)).alias("avg_active_age_days"),
        F.count_if(active & (F.col("workflow_status") == "NEW") & (F.col("first_seen_at") < stale)).alias("stale_new_issues"),
        F.count_if(active & (F.col("workflow_status") == "ACCEPTED_RISK")).alias("accepted_risk_count"),
        F.count_if(passed).alias("passed_closure_count"),
        F.avg(F.when(passed, hours_between(F.col("first_seen_at"), F.col("archived_at")) * 1.0)).alias("avg_hours_to_pass"),
        F.count_if(recent & F.col("is_recurrence")).alias("recurrence_count"),
        F.count_if(recent & F.col("is_potential_regression")).alias("potential_regression_count"),
    )
    done = receipts.select(*_EXECUTION, F.col("outcome").alias("_outcome"))
    in_window = F.col("captured_at") >= since
    status = F.col("status")
    lagging = usable() & F.col("_outcome").isNull()
    ran = executions.join(done, _EXECUTION, "left").groupBy("check_id").agg(
        F.count_if(in_window).alias("recorded_execution_count"),
        F.count_if(in_window & conclusive()).alias("conclusive_execution_count"),
        F.count_if(in_window & conclusive() & (F.col("_outcome") == "applied")).alias("applied_execution_count"),
        F.count_if(in_window & status.isin("configuration_error", "collection_error", "inconclusive")).alias("collection_problem_count"),
        *[F.count_if(in_window & (status == s)).alias(f"{s}_count") for s in ("configuration_error", "collection_error", "limit_reached", "inconclusive")],
        F.sum(F.when(in_window, F.coalesce("owner_conflicts", F.lit(0))).otherwise(0)).alias("owner_conflict_identity_count"),
        F.count_if(in_window & (F.col("failure_count") > 0)).alias("failing_execution_count"),
        F.count_if(status == "pending").alias("pending_collection_count"),
        F.count_if(lagging).alias("processing_lag_count"),
        F.min(F.when(lagging, F.col("captured_at"))).alias("oldest_unprocessed_at"),
        F.max("captured_at").alias("latest_execution_at"),
        F.max_by(F.struct("status", "failure_count"), F.struct("captured_at", "invocation_id")).alias("_latest"),
    )
    skipped = events.where((F.col("event_type") == "EVIDENCE_SKIPPED") & (F.col("event_at") >= since)).groupBy("check_id").agg(
        F.count(F.lit(1)).alias("skipped_evidence_count")
    )
    misses = missed.where(F.col("discovered_at") >= since).groupBy("check_id").agg(F.count(F.lit(1)).alias("known_missed_issue_count"))
    joined = tracked.join(own, "check_id", "left").join(ran, "check_id", "left").join(skipped, "check_id", "left").join(misses, "check_id", "left")
    counts = [c for c in joined.columns if c.endswith("_count") or c in ("active_issues", "stale_new_issues")]
    filled = joined.select(
        *tracked.columns,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        "avg_active_age_days", "avg_hours_to_pass", "oldest_unprocessed_at", "latest_execution_at",
        F.col("_latest.status").alias("latest_collection_status"),
        F.col("_latest.failure_count").alias("latest_observed_failure_count"),
        hours_between(F.col("latest_execution_at"), now).alias("hours_since_latest_execution"),
        F.lit(window_days).alias("reporting_window_days"), F.lit(stale_days).alias("stale_threshold_days"), now.alias("computed_at"),
        raw_pruned_before.alias("raw_pruned_before"),
        F.coalesce(raw_pruned_before > since, F.lit(False)).alias("retention_limits_evidence"),
    )
    tp, fp, population = F.col("tp_count"), F.col("fp_count"), F.col("review_population_count")
    rated = filled.select(
        "*",
        (tp + fp).alias("assessed_count"),
        (population - tp - fp).alias("unreviewed_count"),
        safe_rate(tp, tp + fp).alias("reviewed_precision"),
        safe_rate(fp, tp + fp).alias("fp_share"),
        safe_rate(tp + fp, population).alias("review_coverage"),
        safe_rate(F.col("conclusive_execution_count"), F.col("recorded_execution_count")).alias("collection_coverage"),
        safe_rate(F.col("applied_execution_count"), F.col("conclusive_execution_count")).alias("processing_coverage"),
        ((F.col("failing_execution_count") == 0) & (F.col("recorded_execution_count") > 0)).alias("no_observed_failures"),
    )
    some = lambda c: F.col(c) > 0
    return rated.withColumn(
        "attention_flags",
        flags(
            [
                ("noisy", (F.col("fp_share") >= 0.3) & (F.col("assessed_count") >= 5)),
                ("stale_backlog", some("stale_new_issues")),
                ("limited_collection", some("limit_reached_count")),
                ("collection_problems", some("collection_problem_count")),
                ("lag", some("processing_lag_count")),
                ("skipped_evidence", some("skipped_evidence_count")),
                ("known_misses", some("known_missed_issue_count")),
            ]
        ),
    )


AREA_SUMS = (
    "active_issues", "tp_count", "fp_count", "review_population_count", "potential_regression_count",
    "stale_new_issues", "collection_problem_count", "processing_lag_count", "skipped_evidence_count",
)


def area_health(areas: DataFrame, dependencies: DataFrame, health: DataFrame, missed: DataFrame, now: Column, window_days: int = 30) -> DataFrame:
    """Check health summed over each area's checks, with misses, also of areas without an id."""
    since = now - F.expr(f"interval {int(window_days)} days")
    totals = dependencies.join(health, "check_id").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("tracked_check_count"), *[F.sum(c).alias(c) for c in AREA_SUMS]
    )
    late = missed.where(F.col("discovered_at") >= since)
    n = F.count(F.lit(1)).alias("known_missed_issue_count")
    mapped = late.where("source_id is not null").groupBy("source_id").agg(n)
    unmapped = late.where("source_id is null").groupBy(F.col("area_label").alias("area_name")).agg(n)
    sums = ("tracked_check_count", *AREA_SUMS)
    known = areas.join(totals, "source_id", "left").join(mapped, "source_id", "left").select(
        "source_id", "area_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*sums, "known_missed_issue_count")]
    )
    both = known.unionByName(
        unmapped.select(F.lit(None).cast("string").alias("source_id"), "area_name", *[F.lit(0).cast("long").alias(c) for c in sums], "known_missed_issue_count")
    )
    tp, fp = F.col("tp_count"), F.col("fp_count")
    some = lambda c: F.col(c) > 0
    return both.select(
        "*",
        safe_rate(tp, tp + fp).alias("reviewed_precision"),
        safe_rate(fp, tp + fp).alias("fp_share"),
        (tp + fp).alias("assessed_count"),
        flags(
            [
                ("no_tracked_coverage", F.col("tracked_check_count") == 0),
                ("noisy", (safe_rate(fp, tp + fp) >= 0.3) & (tp + fp >= 5)),
                ("known_misses", some("known_missed_issue_count")),
                ("stale_backlog", some("stale_new_issues")),
                ("collection_problems", some("collection_problem_count")),
                ("lag", some("processing_lag_count")),
                ("skipped_evidence", some("skipped_evidence_count")),
            ]
        ).alias("attention_flags"),
    )


def maintenance_health(steps: DataFrame, log: DataFrame, triggers: DataFrame) -> DataFrame:
    """ok, failing or unknown for each step.

    log: step, invocation_id, outcome, logged_at, trigger_marker_at, trigger_kind, diagnostic_id.
    triggers: invocation_id, marker_at.  A step's baseline is its latest success, or
    its earliest attributed outcome; what came before it no longer matters.
    """
    placed = F.when(F.col("trigger_kind") == "manual", F.col("logged_at")).when(F.col("trigger_kind") == "automatic", F.col("trigger_marker_at"))
    rows = log.withColumn("order_at", placed)
    outcomes = rows.groupBy("step", "invocation_id").agg(
        F.when(F.min("outcome") == F.max("outcome"), F.min("outcome")).otherwise("ambiguous").alias("outcome"),
        F.when(F.count(F.lit(1)) == F.count("order_at"), F.max("order_at")).alias("order_at"),
        F.max("logged_at").alias("logged_at"),
    )
    good = F.max(F.when(F.col("outcome") == "succeeded", F.col("order_at")))
    marks = outcomes.groupBy("step").agg(F.coalesce(good, F.min("order_at")).alias("mark"), F.max(F.when(F.col("order_at").isNotNull(), F.col("logged_at"))).alias("attributed_at"))
    ends = triggers.groupBy("invocation_id").agg(F.max("marker_at").alias("marker_at"))
    # every invocation after the mark owes each of the few steps an outcome
    owed = ends.join(F.broadcast(marks.join(steps, "step").select("step", "mark")), F.col("marker_at") >= F.col("mark"))
    missing = owed.join(outcomes, ["step", "invocation_id"], "left_anti").groupBy("step").agg(F.count(F.lit(1)).alias("n_missing"))
    after = F.col("order_at") >= F.col("mark")
    counted = outcomes.join(marks, "step").groupBy("step").agg(
        F.count_if((F.col("outcome") == "failed") & after).alias("n_failed"),
        F.count_if((F.col("outcome") == "ambiguous") & (F.col("order_at").isNull() | after) & F.col("mark").isNotNull()).alias("n_ambiguous"),
        F.count_if(F.col("order_at").isNull() & ~F.coalesce(F.col("attributed_at") > F.col("logged_at"), F.lit(False))).alias("n_pending"),
    )
    shown = rows.groupBy("step").agg(
        F.max(F.when(F.col("outcome") == "succeeded", F.col("logged_at"))).alias("last_success_at"),
        F.max(F.when(F.col("outcome") == "failed", F.col("logged_at"))).alias("last_failure_at"),
        F.max_by("diagnostic_id", F.when(F.col("outcome") == "failed", F.col("logged_at"))).alias("last_failure_diagnostic_id"),
    )
    met = steps.join(marks, "step", "left").join(missing, "step", "left").join(counted, "step", "left").join(shown, "step", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    state = (
        F.when(F.col("mark").isNull() | some("n_missing") | some("n_ambiguous") | some("n_pending"), "unknown")
        .when(some("n_failed"), "failing")
        .otherwise("ok")
    )
    return met.select("step", "last_success_at", "last_failure_at", "last_failure_diagnostic_id", state.alias("state"))


def owner_summary(occurrences: DataFrame, events: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per owner: what the frozen inputs of one run opened and closed, and what is open now."""
    kinds = {"opened": "APPEARED", "recurring": "REAPPEARED", "archived": "DISAPPEARED"}
    changes = (
        events.where(F.col("event_type").isin(*kinds.values()))
        .join(inputs.select(*_EXECUTION), _EXECUTION, "left_semi")
        .groupBy("occurrence_id")
        .agg(*[F.max((F.col("event_type") == e).cast("int")).alias(n) for n, e in kinds.items()])
    )
    active = F.col("record_status") == "Active"
    fresh = F.upper(F.coalesce(F.nullif(F.trim("workflow_status"), F.lit("")), F.lit("NEW"))) == "NEW"
    return (
        occurrences.join(changes, "occurrence_id", "left")
        .where(active | F.col("opened").isNotNull())
        .groupBy(owner_of(F.col("owner")).alias("owner"))
        .agg(
            *[F.sum(F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in kinds],
            F.count_if(active & fresh).alias("new"),
            F.count_if(active).alias("active"),
        )
    )


def by_owner(summary: DataFrame) -> list[dict]:
    """The rows of owner_summary() as they are shown: most new issues first, and always one for those without an owner."""
    rows = [r.asDict() for r in summary.collect()]  # one for each owner
    if not any(r["owner"] == "Unassigned" for r in rows):
        rows.append({c: "Unassigned" if c == "owner" else 0 for c in summary.columns})
    return sorted(rows, key=lambda r: (-r["new"], r["owner"].casefold(), r["owner"]))


def run_summary(ledger, run_id: str) -> list[dict]:
    """by_owner() of one reconciliation; refused unless it has completed and nothing came after it."""
    manifest = ledger.manifest()
    run = ledger.read("runs", manifest).where(F.col("run_id") == run_id).first()
    if run is None or run.status != "completed" or run.generation_at_freeze + 1 != manifest["generation"]:
        raise RuntimeError("the run is unavailable or the evidence has changed since")
    inputs = ledger.read("inputs", manifest).where(F.col("run_id") == run_id)
    return by_owner(owner_summary(ledger.read("occurrences", manifest), ledger.read("events", manifest), inputs))


def by_attention(health: DataFrame) -> DataFrame:
    """Check or area health with most attention flags first."""
    flags_ = F.size(F.filter(F.split("attention_flags", ","), lambda f: f != ""))
    return health.withColumn("_flags", flags_).orderBy(F.desc("_flags"), *[c for c in ("check_id", "source_id") if c in health.columns]).drop("_flags")


def structural_closures(events: DataFrame, inputs: DataFrame) -> DataFrame:
    return (
        events.where("event_type = 'CLOSED_STRUCTURAL'")
        .join(inputs.select(*_EXECUTION), _EXECUTION, "left_semi")
        .agg(F.countDistinct("occurrence_id").alias("structural"))
    )
