"""Registered queries over the lab ledger: each operator with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.identity import event_id
from faultline.functions.payload import changed_keys, payload_changed
from faultline.operators import apply, browse, export, reconcile, replay, retention, review, views
from faultline.plans import lab_sql as L
from faultline.plans.lab import Lab, now
from faultline.plans.lab import review as reviewed
from faultline.sources.scratch import changed_at, scratch_path
from faultline.sources.store import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_labs: dict[tuple[str, ...], Lab] = {}


def _stored(spark: SparkSession, sf_dir: str) -> Lab:
    """The ledger of one input as it is now, whose stored tables the queries of an application share."""
    key = (spark.sparkContext.applicationId, sf_dir, *changed_at(spark, f"{sf_dir}/events.parquet"), *changed_at(spark, f"{sf_dir}/customer.parquet"))
    if key not in _labs:
        _labs[key] = Lab(spark, sf_dir)
    return _labs[key]


def query(sql: str):
    def register(f: Callable[[Lab], DataFrame]) -> Callable[[Lab], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_stored(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ts(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def tss(*columns: str) -> str:
    return ", ".join(f"{L.shown(c)} as {c}" for c in columns)


_TIMES = ("first_seen_at", "last_seen_at", "archived_at", "annotated_at")
_PLAIN = [c for c in replay._COLUMNS if c not in _TIMES]


def whole(occurrences: DataFrame) -> DataFrame:
    return occurrences.select(*_PLAIN, *[ts(c) for c in _TIMES])


_WHOLE = f"{', '.join(_PLAIN)}, {tss(*_TIMES)}"
_EVENT = ["event_id", "check_id", "occurrence_id", "identity", "invocation_id", "event_type"]


# freezing and guards


@query(L.base(f"select check_id, invocation_id, {tss('captured_at')} from execs where {L.USABLE} and n > 28 and check_id in (select check_id from tracked)"))
def freeze_inputs(lab: Lab) -> DataFrame:
    return apply.freeze(lab.executions, lab.receipts, lab.tracked).select("check_id", "invocation_id", ts("captured_at"))


@query(L.ledger(f"select e.check_id, e.invocation_id, {L.shown('e.captured_at')} as captured_at from execs e join hw on e.check_id = hw.check_id where {L.USABLE} and e.n between 25 and 30 and (e.captured_at < hw.captured_at or (e.captured_at = hw.captured_at and e.invocation_id <= hw.invocation_id))"))
def late_evidence(lab: Lab) -> DataFrame:
    frozen = lab.batch(25, 30)[0].select("check_id", "invocation_id", "captured_at")
    return apply.late(frozen, apply.high_water(lab.batch(1, 28)[0])).select("check_id", "invocation_id", ts("captured_at"))


@query(L.ledger(f"select check_id, invocation_id, {tss('captured_at')} from hw"))
def high_water(lab: Lab) -> DataFrame:
    return apply.high_water(lab.batch(1, 28)[0]).select("check_id", "invocation_id", ts("captured_at"))


@query(L.ledger("select occurrence_id, check_id, number from occ where record_status = 'Active' and (check_id = 'events.error' or check_id not in (select check_id from tracked))"))
def active_scope(lab: Lab) -> DataFrame:
    frozen = lab.batch(29, 30)[0].where("check_id = 'events.error'")
    frozen = frozen.unionByName(lab.executions.where("n = 28 and check_id = 'events.error'"))
    return apply.in_scope(lab.occurrences, frozen, lab.tracked).select("occurrence_id", "check_id", "number")


@query(L.ledger("select check_id, identity, scheme from obs where n between 16 and 28 union select check_id, identity, scheme from occ1 where record_status = 'Active'"))
def candidate_identities(lab: Lab) -> DataFrame:
    return replay.candidates(lab.batch(16, 28)[1], lab.reviewed.where("record_status = 'Active'"))


@query(L.ledger("select occurrence_id, number from occ1 where exists (select 1 from obs o where o.n = 16 and o.check_id = occ1.check_id and o.identity = occ1.identity)"))
def affected_history(lab: Lab) -> DataFrame:
    return apply.affected(lab.reviewed, lab.batch(16, 16)[1]).select("occurrence_id", "number")


# replay


@query(L.ledger("select check_id, identity, scheme, invocation_id, failing, was_failing, starts, episode from r2_st"))
def replay_states(lab: Lab) -> DataFrame:
    return lab.second_states.select("check_id", "identity", "scheme", "invocation_id", "failing", "was_failing", "starts", "episode")


@query(L.ledger(f"select check_id, identity, scheme, episode, n_failing, f.inv as first_invocation, l.inv as last_invocation, {L.shown('a.at')} as absent_at from r1_r"))
def replay_episodes(lab: Lab) -> DataFrame:
    absent = F.date_format("absence.captured_at", "yyyy-MM-dd HH:mm:ss").alias("absent_at")
    return replay.episodes(lab.first_considered).select(
        "check_id", "identity", "scheme", "episode", "n_failing",
        F.col("first.invocation_id").alias("first_invocation"), F.col("last.invocation_id").alias("last_invocation"), absent,
    )


@query(L.ledger(f"select {_WHOLE} from r2_occ"))
def replay_occurrences(lab: Lab) -> DataFrame:
    return whole(replay.occurrences(lab.second_considered, lab.reviewed))


@query(L.ledger("select s.check_id, count(*) as states, count(*) filter (failing) as failing_states, count(distinct s.identity) as identities from r2_st s join execs e on e.check_id = s.check_id and e.invocation_id = s.invocation_id where e.status = 'limit_reached' group by all"))
def replay_limited(lab: Lab) -> DataFrame:
    return lab.second_states.where("status = 'limit_reached'").groupBy("check_id").agg(
        F.count(F.lit(1)).alias("states"), F.count_if("failing").alias("failing_states"), F.countDistinct("identity").alias("identities")
    )


@query(L.ledger(f"select {', '.join(_EVENT)}, {tss('event_at')} from r2_ev"))
def lifecycle_events(lab: Lab) -> DataFrame:
    return lab.second_events.select(*_EVENT, ts("event_at"))


@query(L.ledger("""
select event_id, null::varchar as previous_payload, null::varchar as payload, 'changed_columns' as payload_mode,
    case when event_type = 'VALUES_CHANGED' then 'band' end as changed_columns,
    sha256(previous_payload) as previous_digest, sha256(payload) as digest from r2_ev"""))
def event_payload_modes(lab: Lab) -> DataFrame:
    names = ("event_id", "previous_payload", "payload", "payload_mode", "changed_columns", "previous_digest", "digest")
    return replay.event_payloads(lab.second_events, "changed_columns").select(*names)


@query(L.ledger(f"""
select occurrence_id, check_id, 'Archived' as record_status, 'TEST_REMOVED' as close_reason, workflow_status as workflow_at_close, {L.shown(L.NOW)} as archived_at,
    {L.event_id("check_id", "occurrence_id", "'sweep-1'", "'CLOSED_STRUCTURAL'")} as event_id
from occ where record_status = 'Active' and check_id not in (select check_id from tracked)"""))
def test_removed_sweep(lab: Lab) -> DataFrame:
    closed, events = replay.removed_checks(lab.occurrences, lab.tracked, now(), "sweep-1")
    return closed.join(events.select("occurrence_id", "event_id"), "occurrence_id").select(
        "occurrence_id", "check_id", "record_status", "close_reason", "workflow_at_close", ts("archived_at"), "event_id"
    )


@query(L.ledger(f"select event_id, {L.event_id('check_id', 'occurrence_id', 'invocation_id', 'event_type')} as again, {L.event_id('check_id', 'null::varchar', 'invocation_id', 'event_type')} as without_occurrence from r1_ev"))
def event_ids(lab: Lab) -> DataFrame:
    f = {c: F.col(c) for c in ("check_id", "occurrence_id", "invocation_id", "event_type")}
    return lab.first_events.select(
        "event_id", event_id(*f.values()).alias("again"), event_id(*(f | {"occurrence_id": F.lit(None).cast("string")}).values()).alias("without_occurrence")
    )


@query(L.ledger("""
select event_id, case when previous_payload is null or payload = previous_payload then null else
    (select string_agg(k, ',' order by k) from unnest(['user_id', 'event_type', 'band']) t(k)
     where json_extract_string(payload, '$.' || k) is distinct from json_extract_string(previous_payload, '$.' || k)) end as changed,
    payload is distinct from previous_payload as differs
from r2_ev where event_type in ('VALUES_CHANGED', 'APPEARED')"""))
def changed_keys_query(lab: Lab) -> DataFrame:
    chosen = lab.second_events.where("event_type in ('VALUES_CHANGED', 'APPEARED')")
    keys = F.when(F.col("previous_payload").isNotNull(), changed_keys(F.col("previous_payload"), F.col("payload")))
    return chosen.select("event_id", keys.alias("changed"), payload_changed(F.col("previous_payload"), F.col("payload")).alias("differs"))


for _registry in (QUERIES, ORACLE_SQL):
    _registry["changed_keys"] = _registry.pop("changed_keys_query")


# applying


@query(L.ledger("select event_id, check_id, event_type from ev"))
def insert_new_rows(lab: Lab) -> DataFrame:
    """The second batch sent twice over the first: each event is there once."""
    target, second = [events.select("event_id", "check_id", "event_type") for events in lab.stored_events]
    twice = second.unionByName(second).unionByName(target)
    return target.unionByName(apply.insert_new(target, twice, ["event_id"]))


@query(L.ledger(f"select {_WHOLE} from occ"))
def apply_upsert(lab: Lab) -> DataFrame:
    return whole(apply.merged(lab.reviewed, lab.second_changes.drop("episode")))


@query(L.ledger(f"select {_WHOLE}, 3 as generation, 3 as completed_runs, (select count(*) from ev where ev.occurrence_id = occ.occurrence_id) as n_events from occ"))
def reconcile_thrice(lab: Lab) -> DataFrame:
    """A ledger of its own: days 1 to 15 are reconciled and reviewed, then days 16 to 28, then nothing new, which changes nothing."""
    ledger = Ledger(lab.spark, scratch_path(lab.spark, "ledger"))
    ledger.create(reconcile.TABLES)
    tracked = lab.executions.select("check_id").distinct()
    for run, (first, last) in {"run-1": (1, 15), "run-2": (16, 28), "run-3": (1, 0)}.items():
        days = F.col("n").between(first, last)
        found = {"executions": lab.executions.where(days), "observations": lab.observations.where(days)}
        ledger.commit(ledger.manifest(), append={t: reconcile.shaped(rows, t) for t, rows in found.items()})
        reconcile.reconcile(ledger, tracked, run, now())
        if run == "run-1":
            ledger.commit(ledger.manifest(), replace={"occurrences": reviewed(ledger.read("occurrences"))})
    done = ledger.read("runs").where("status = 'completed'").count()
    events = ledger.read("events").groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("n_events"))
    return whole(ledger.read("occurrences")).join(events, "occurrence_id").select(
        "*", F.lit(ledger.manifest()["generation"]).alias("generation"), F.lit(done).cast("int").alias("completed_runs")
    )


_PATCHED = "record_status = 'Active' and identity[3] <= 'b'"
_EDITED = "record_status = 'Active' and identity[3] <= '8'"


def patches(lab: Lab) -> DataFrame:
    """Edits on three quarters of the open issues; some are made on a version that is gone."""
    at = F.substring("identity", 3, 1)
    chosen = lab.occurrences.where("record_status = 'Active'").where(at <= "b")
    base = F.when(at > "8", F.col("version") + 7).otherwise(F.col("version"))
    edits = F.array(
        F.struct(F.lit("workflow_status").alias("field_name"), F.lit("IN_PROGRESS").alias("new_value")),
        F.struct(F.lit("owner").alias("field_name"), F.when(at <= "2", F.lit(None).cast("string")).otherwise("dora").alias("new_value")),
    )
    return chosen.select("occurrence_id", F.explode(edits).alias("e"), base.alias("base_version")).select("occurrence_id", "e.*", "base_version")


@query(L.ledger(f"""
select occurrence_id, {_EDITED} as edited, case when {_EDITED} then 'IN_PROGRESS' else workflow_status end as workflow_status,
    case when {_EDITED} then case when identity[3] > '2' then 'dora' end else owner end as owner,
    version + cast({_EDITED} as integer) as version, cast(case when {_EDITED} then 2 else 0 end as bigint) as audited,
    case when {_EDITED} then workflow_status end as old_status
from occ"""))
def annotation_apply(lab: Lab) -> DataFrame:
    after, audit = review.applied(lab.occurrences, patches(lab), "batch-1", now())
    old = F.max(F.when(F.col("field_name") == "workflow_status", F.col("old_value"))).alias("old_status")
    made = audit.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("audited"), old)
    return after.join(made, "occurrence_id", "left").select(
        "occurrence_id", F.col("audited").isNotNull().alias("edited"), "workflow_status", "owner", "version", F.coalesce("audited", F.lit(0)).alias("audited"), "old_status"
    )


@query(L.ledger(f"""
select occurrence_id, 'workflow_status' as field_name, case when identity[4] <= '7' then 'NEW' else 'TRIAGED' end as base_value, workflow_status as current_value,
    0 as base_version, version as current_version
from occ where {_PATCHED} and (workflow_status <> case when identity[4] <= '7' then 'NEW' else 'TRIAGED' end or version <> 0)"""))
def annotation_drift(lab: Lab) -> DataFrame:
    believed = F.when(F.substring("identity", 4, 1) <= "7", "NEW").otherwise("TRIAGED").alias("base_value")
    edits = patches(lab).where("field_name = 'workflow_status'").join(lab.occurrences.select("occurrence_id", "identity"), "occurrence_id")
    return review.drift(edits.select("occurrence_id", "field_name", believed, F.lit(0).alias("base_version")), lab.occurrences)


@query(L.ledger(f"select event_id, check_id, invocation_id, {tss('event_at')}, 'skipped_late' as outcome from skips"))
def skip_late(lab: Lab) -> DataFrame:
    events, receipts = lab.late_skips
    return events.join(receipts, ["check_id", "invocation_id"]).select("event_id", "check_id", "invocation_id", ts("event_at"), "outcome")


# views

_ISSUE = "occurrence_id, number, record_status, has_previous, is_recurrence, is_potential_regression, previous_occurrence_id, previous_close_reason, previous_workflow_at_close"


@query(L.ledger(f"select {_ISSUE} from hist"))
def issue_history(lab: Lab) -> DataFrame:
    return lab.issues.select(*_ISSUE.split(", "))


@query(L.ledger(f"select {_ISSUE} from hist where record_status = 'Active'"))
def current_issues(lab: Lab) -> DataFrame:
    return views.history(lab.occurrences, active_only=True).select(*_ISSUE.split(", "))


@query(L.ledger(f"select occurrence_id, number, {L.shown('first_seen_at')} as valid_from, {L.shown('archived_at')} as valid_to, close_reason, record_status = 'Active' as is_current, payload from occ"))
def issue_timeline(lab: Lab) -> DataFrame:
    return views.timeline(lab.occurrences).select("occurrence_id", "number", ts("valid_from"), ts("valid_to"), "close_reason", "is_current", "payload")


_SINCE = f"{L.NOW} - interval 30 day"
_HEALTH_SQL = f"""
, own as (
    select check_id, count(*) filter (first_seen_at >= {_SINCE}) as review_population_count,
        count(*) filter (first_seen_at >= {_SINCE} and verdict = 'TRUE_POSITIVE') as tp_count,
        count(*) filter (first_seen_at >= {_SINCE} and verdict = 'FALSE_POSITIVE') as fp_count,
        count(*) filter (record_status = 'Active') as active_issues,
        avg({L.hours("first_seen_at", L.NOW)} / 24.0) filter (record_status = 'Active') as avg_active_age_days,
        count(*) filter (record_status = 'Active' and workflow_status = 'NEW' and first_seen_at < {L.NOW} - interval 14 day) as stale_new_issues,
        count(*) filter (record_status = 'Active' and workflow_status = 'ACCEPTED_RISK') as accepted_risk_count,
        count(*) filter (close_reason = 'Passed' and archived_at >= {_SINCE}) as passed_closure_count,
        avg({L.hours("first_seen_at", "archived_at")} * 1.0) filter (close_reason = 'Passed' and archived_at >= {_SINCE}) as avg_hours_to_pass,
        count(*) filter (first_seen_at >= {_SINCE} and is_recurrence) as recurrence_count,
        count(*) filter (first_seen_at >= {_SINCE} and is_potential_regression) as potential_regression_count
    from hist group by check_id),
ran as (
    select e.check_id, count(*) filter (captured_at >= {_SINCE}) as recorded_execution_count,
        count(*) filter (captured_at >= {_SINCE} and {L.CONCLUSIVE}) as conclusive_execution_count,
        count(*) filter (captured_at >= {_SINCE} and {L.CONCLUSIVE} and outcome = 'applied') as applied_execution_count,
        count(*) filter (captured_at >= {_SINCE} and status in ('configuration_error', 'collection_error', 'inconclusive')) as collection_problem_count,
        count(*) filter (captured_at >= {_SINCE} and status = 'limit_reached') as limit_reached_count,
        cast(coalesce(sum(owner_conflicts) filter (captured_at >= {_SINCE}), 0) as bigint) as owner_conflict_identity_count,
        count(*) filter (captured_at >= {_SINCE} and failure_count > 0) as failing_execution_count,
        count(*) filter (status = 'pending') as pending_collection_count,
        count(*) filter ({L.USABLE} and outcome is null) as processing_lag_count,
        min(captured_at) filter ({L.USABLE} and outcome is null) as oldest_unprocessed_at,
        max(captured_at) as latest_execution_at, arg_max(status, captured_at) as latest_collection_status,
        arg_max(failure_count, captured_at) as latest_observed_failure_count
    from execs e left join receipts r on r.check_id = e.check_id and r.invocation_id = e.invocation_id group by e.check_id),
sk as (select check_id, count(*) as skipped_evidence_count from skips where event_at >= {_SINCE} group by check_id),
mi as (select check_id, count(*) as known_missed_issue_count from missed where discovered_at >= {_SINCE} group by check_id),
h as (
    select t.*, o.* exclude (check_id), r.* exclude (check_id), coalesce(skipped_evidence_count, 0) as skipped_evidence_count,
        coalesce(known_missed_issue_count, 0) as known_missed_issue_count, tp_count + fp_count as assessed_count,
        fp_count / nullif(tp_count + fp_count, 0)::double as fp_share
    from tracked t left join own o on o.check_id = t.check_id left join ran r on r.check_id = t.check_id
        left join sk on sk.check_id = t.check_id left join mi on mi.check_id = t.check_id)"""


@query(L.ledger(_HEALTH_SQL.lstrip("\n") + f"""
select check_id, check_name, severity, review_population_count, tp_count, fp_count, active_issues, stale_new_issues, accepted_risk_count, passed_closure_count,
    recurrence_count, potential_regression_count, recorded_execution_count, conclusive_execution_count, applied_execution_count, collection_problem_count,
    limit_reached_count, owner_conflict_identity_count, failing_execution_count, pending_collection_count, processing_lag_count,
    skipped_evidence_count, known_missed_issue_count, assessed_count, latest_collection_status, latest_observed_failure_count,
    review_population_count - tp_count - fp_count as unreviewed_count,
    round(avg_active_age_days, 6) as avg_active_age_days, round(avg_hours_to_pass, 6) as avg_hours_to_pass,
    {tss("oldest_unprocessed_at", "latest_execution_at")}, {L.hours("latest_execution_at", L.NOW)} as hours_since_latest_execution,
    true as retention_limits_evidence, round(fp_share, 6) as fp_share, round(tp_count / nullif(tp_count + fp_count, 0)::double, 6) as reviewed_precision,
    round((tp_count + fp_count) / nullif(review_population_count, 0)::double, 6) as review_coverage,
    round(conclusive_execution_count / nullif(recorded_execution_count, 0)::double, 6) as collection_coverage,
    round(applied_execution_count / nullif(conclusive_execution_count, 0)::double, 6) as processing_coverage,
    failing_execution_count = 0 and recorded_execution_count > 0 as no_observed_failures,
    case when fp_share >= 0.3 and assessed_count >= 5 then 'noisy,' else '' end || case when stale_new_issues > 0 then 'stale_backlog,' else '' end ||
    case when limit_reached_count > 0 then 'limited_collection,' else '' end || case when collection_problem_count > 0 then 'collection_problems,' else '' end ||
    case when processing_lag_count > 0 then 'lag,' else '' end || case when skipped_evidence_count > 0 then 'skipped_evidence,' else '' end ||
    case when known_missed_issue_count > 0 then 'known_misses,' else '' end as attention_flags
from h"""))
def check_health(lab: Lab) -> DataFrame:
    rounded = ("avg_active_age_days", "avg_hours_to_pass", "fp_share", "reviewed_precision", "review_coverage", "collection_coverage", "processing_coverage")
    times = ("oldest_unprocessed_at", "latest_execution_at")
    left_out = ("configuration_error_count", "collection_error_count", "inconclusive_count", "reporting_window_days", "stale_threshold_days", "computed_at", "raw_pruned_before")
    plain = [c for c in lab.health.columns if c not in (*rounded, *times, *left_out)]
    return lab.health.select(*plain, *[F.round(c, 6).alias(c) for c in rounded], *[ts(c) for c in times])


_AREAS = "(values ('area.0', 'orders'), ('area.1', 'customers'), ('area.2', 'parts'))"


@query(L.ledger(_HEALTH_SQL.lstrip("\n") + f""",
deps as (select 'area.' || k as source_id, check_id from tracked, (values (0), (1)) v(k) where k = 0 or check_id in ('events.click', 'events.view')),
tot as (
    select source_id, count(*) as tracked_check_count, sum(active_issues) as active_issues, sum(tp_count) as tp_count, sum(fp_count) as fp_count,
        sum(stale_new_issues) as stale_new_issues, sum(collection_problem_count) as collection_problem_count, sum(processing_lag_count) as processing_lag_count,
        sum(skipped_evidence_count) as skipped_evidence_count
    from deps join h using (check_id) group by source_id),
late as (select * from missed where discovered_at >= {_SINCE}),
a as (
    select s.source_id, s.area_name, coalesce(tracked_check_count, 0) as tracked_check_count, coalesce(active_issues, 0) as active_issues, coalesce(tp_count, 0) as tp_count,
        coalesce(fp_count, 0) as fp_count, coalesce(stale_new_issues, 0) as stale_new_issues, coalesce(collection_problem_count, 0) as collection_problem_count,
        coalesce(processing_lag_count, 0) as processing_lag_count, coalesce(skipped_evidence_count, 0) as skipped_evidence_count,
        (select count(*) from late where late.source_id = s.source_id) as known_missed_issue_count
    from {_AREAS} s(source_id, area_name) left join tot on tot.source_id = s.source_id
    union all select null, area_label, 0, 0, 0, 0, 0, 0, 0, 0, count(*) from late where source_id is null group by area_label)
select source_id, area_name, cast(tracked_check_count as bigint) as tracked_check_count, cast(active_issues as bigint) as active_issues,
    cast(tp_count as bigint) as tp_count, cast(fp_count as bigint) as fp_count, cast(known_missed_issue_count as bigint) as known_missed_issue_count,
    case when tracked_check_count = 0 then 'no_tracked_coverage,' else '' end ||
    case when fp_count / nullif(tp_count + fp_count, 0)::double >= 0.3 and tp_count + fp_count >= 5 then 'noisy,' else '' end ||
    case when known_missed_issue_count > 0 then 'known_misses,' else '' end || case when stale_new_issues > 0 then 'stale_backlog,' else '' end ||
    case when collection_problem_count > 0 then 'collection_problems,' else '' end || case when processing_lag_count > 0 then 'lag,' else '' end ||
    case when skipped_evidence_count > 0 then 'skipped_evidence,' else '' end as attention_flags
from a"""))
def area_health(lab: Lab) -> DataFrame:
    areas = lab.spark.createDataFrame([("area.0", "orders"), ("area.1", "customers"), ("area.2", "parts")], "source_id string, area_name string")
    some = lab.tracked.select("check_id")
    dependencies = some.select(F.lit("area.0").alias("source_id"), "check_id").unionByName(
        some.where("check_id in ('events.click', 'events.view')").select(F.lit("area.1").alias("source_id"), "check_id")
    )
    found = views.area_health(areas, dependencies, lab.health, lab.missed, now())
    return found.select("source_id", "area_name", "tracked_check_count", "active_issues", "tp_count", "fp_count", "known_missed_issue_count", "attention_flags")


_LOG_SQL = """
lg as (
    select 'step' || (o_orderkey % 5) as step, 'run-' || (o_orderkey % 97) as invocation_id,
        case when o_orderkey % 5 = 1 and o_orderkey % 11 = 3 then 'failed' when o_orderkey % 5 = 3 then 'failed' else 'succeeded' end as outcome,
        o_orderdate + to_days(cast(o_orderkey % 97 as integer)) as logged_at, timestamp '2024-01-01' + to_days(cast(o_orderkey % 97 as integer)) as trigger_marker_at,
        case when o_orderkey % 5 = 4 and o_orderkey % 13 = 2 then null when o_orderkey % 7 = 0 then 'manual' else 'automatic' end as trigger_kind,
        'd' || o_orderkey as diagnostic_id, o_orderkey % 5 as s
    from orders),
io as (
    select step, invocation_id, case when min(outcome) = max(outcome) then min(outcome) else 'ambiguous' end as outcome,
        case when count(*) = count(oa) then max(oa) end as order_at, max(logged_at) as logged_at
    from (select *, case trigger_kind when 'manual' then logged_at when 'automatic' then trigger_marker_at end as oa from lg) group by 1, 2),
trg as (select 'run-' || k as invocation_id, timestamp '2024-01-01' + to_days(cast(k as integer)) as marker_at from (select unnest(generate_series(0, 96)) as k)),
ex as (select 'step' || k as step from (select unnest(generate_series(0, 5)) as k)),
th as (select ex.step, coalesce(max(order_at) filter (outcome = 'succeeded'), min(order_at)) as mark from ex left join io on io.step = ex.step group by ex.step)
select th.step, strftime((select max(logged_at) from lg where lg.step = th.step and outcome = 'succeeded'), '%Y-%m-%d %H:%M:%S') as last_success_at,
    strftime((select max(logged_at) from lg where lg.step = th.step and outcome = 'failed'), '%Y-%m-%d %H:%M:%S') as last_failure_at,
    case when mark is null then 'unknown'
        when exists (select 1 from trg where marker_at >= mark and not exists (select 1 from io where io.step = th.step and io.invocation_id = trg.invocation_id)) then 'unknown'
        when exists (select 1 from io where io.step = th.step and outcome = 'ambiguous' and (order_at is null or order_at >= mark)) then 'unknown'
        when exists (select 1 from io u where u.step = th.step and order_at is null and not exists (
            select 1 from io a where a.step = u.step and a.order_at is not null and a.logged_at > u.logged_at)) then 'unknown'
        when exists (select 1 from io where io.step = th.step and outcome = 'failed' and order_at >= mark) then 'failing' else 'ok' end as state
from th"""


@query("with " + _LOG_SQL)
def maintenance_health(lab: Lab) -> DataFrame:
    """Six steps and a log made from orders; the sixth step has never run."""
    k, spark = F.col("o_orderkey"), lab.spark
    day = lambda n: F.make_dt_interval(n.cast("int"))
    marker = F.expr("timestamp_ntz '2024-01-01'") + day(k % 97)
    log = lab.table("orders").select(
        F.concat(F.lit("step"), (k % 5).cast("string")).alias("step"),
        F.concat(F.lit("run-"), (k % 97).cast("string")).alias("invocation_id"),
        F.when((k % 5 == 1) & (k % 11 == 3), "failed").when(k % 5 == 3, "failed").otherwise("succeeded").alias("outcome"),
        (F.col("o_orderdate") + day(k % 97)).alias("logged_at"),
        marker.alias("trigger_marker_at"),
        F.when((k % 5 == 4) & (k % 13 == 2), F.lit(None)).when(k % 7 == 0, "manual").otherwise("automatic").alias("trigger_kind"),
        F.concat(F.lit("d"), k.cast("string")).alias("diagnostic_id"),
    )
    ids = spark.range(97).select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("invocation_id"), (F.expr("timestamp_ntz '2024-01-01'") + day(F.col("id"))).alias("marker_at"))
    steps = spark.range(6).select(F.concat(F.lit("step"), F.col("id").cast("string")).alias("step"))
    return views.maintenance_health(steps, log, ids).select("step", ts("last_success_at"), ts("last_failure_at"), "state")


@query(L.ledger("""
, ch as (
    select occurrence_id, max(cast(event_type = 'APPEARED' as integer)) as opened, max(cast(event_type = 'REAPPEARED' as integer)) as recurring,
        max(cast(event_type = 'DISAPPEARED' as integer)) as archived
    from ev join (select check_id, invocation_id from execs where n between 24 and 28) using (check_id, invocation_id)
    where event_type in ('APPEARED', 'REAPPEARED', 'DISAPPEARED') group by 1)
select coalesce(nullif(trim(owner), ''), 'Unassigned') as owner, cast(sum(coalesce(opened, 0)) as bigint) as opened, cast(sum(coalesce(recurring, 0)) as bigint) as recurring,
    cast(sum(coalesce(archived, 0)) as bigint) as archived,
    count(*) filter (record_status = 'Active' and upper(coalesce(nullif(trim(workflow_status), ''), 'NEW')) = 'NEW') as "new", count(*) filter (record_status = 'Active') as active
from occ left join ch on ch.occurrence_id = occ.occurrence_id where record_status = 'Active' or ch.occurrence_id is not null group by 1""".lstrip("\n")))
def owner_summary(lab: Lab) -> DataFrame:
    return views.owner_summary(lab.occurrences, lab.events, lab.executions.where("n between 24 and 28"))


# browsing

_RANK = "case lower(coalesce(priority, '')) when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"
_FILTERED = """record_status = 'Active' and upper(coalesce(workflow_status, 'NEW')) in ('NEW', 'BLOCKED') and coalesce(nullif(trim(owner), ''), 'Unassigned') in ('alice', 'bob')
    and coalesce(priority, 'unset') in ('critical', 'medium', 'unset') and check_id <> 'events.purchase' and first_seen_at >= timestamp '2024-01-10' and is_recurrence"""
FILTERS = browse.Filters(
    statuses=("new", "blocked"), owners=("alice", "bob"), priorities=("critical", "medium", "unset"),
    tags=("error", "click", "view", "signup"), created_from=datetime(2024, 1, 10), recurrences_only=True,
)
ALL = browse.Filters(lifecycle=None)


@query(L.ledger(f"select occurrence_id, {_RANK} as rank, {tss('first_seen_at')} from hist where {_FILTERED}"))
def browse_filters(lab: Lab) -> DataFrame:
    return browse.keys(lab.issues, FILTERS).select("occurrence_id", "rank", ts("first_seen_at"))


@query(L.ledger("select occurrence_id, check_id from hist where record_status = 'Active' and contains(lower(concat_ws(' ', check_name, identity, payload, workflow_status, coalesce(owner, ''), coalesce(call_to_action, ''), coalesce(notes, ''), coalesce(ticket_url, ''), coalesce(priority, ''), tags)), '\"user_id\":\"1')"))
def browse_search(lab: Lab) -> DataFrame:
    return lab.issues.where(browse.Filters(search='"USER_ID":"1').predicate()).select("occurrence_id", "check_id")


_PAGE = f"select occurrence_id, {_RANK} as rank, first_seen_at from hist"


@query(L.ledger(f"select occurrence_id, rank, {tss('first_seen_at')} from (select *, first_seen_at as hist_seen from ({_PAGE})) where (rank, first_seen_at, occurrence_id) > (2, timestamp '2024-01-09', '8') order by rank, hist_seen, occurrence_id limit 201"))
def browse_page(lab: Lab) -> DataFrame:
    after = (2, datetime(2024, 1, 9), "8")
    return browse.page_keys(lab.issues, ALL, 200, after).select("occurrence_id", "rank", ts("first_seen_at"))


@query(L.ledger(f"select {_WHOLE} from hist where occurrence_id in (select occurrence_id from ({_PAGE}) order by rank, first_seen_at, occurrence_id limit 51)"))
def browse_two_phase(lab: Lab) -> DataFrame:
    return whole(browse.rows_of(lab.issues, browse.page_keys(lab.issues, ALL, 50)))


@query(L.ledger(f"""
select count(*) filter (record_status = 'Active') as active, count(*) filter (record_status = 'Active' and workflow_status = 'NEW') as "new",
    count(*) filter (record_status = 'Active' and workflow_status = 'BLOCKED') as blocked, count(*) filter (record_status = 'Active' and {_RANK} <= 1) as urgent,
    count(*) filter (record_status = 'Active' and is_recurrence) as recurring, count(*) filter ({_FILTERED}) as matching from hist"""))
def browse_metrics(lab: Lab) -> DataFrame:
    return browse.metrics(lab.issues, FILTERS)


@query(L.ledger("""
select distinct kind, value from (
    select 'owner' as kind, coalesce(nullif(trim(owner), ''), 'Unassigned') as value from hist where record_status = 'Active'
    union all select 'status', upper(workflow_status) from hist where record_status = 'Active'
    union all select 'tag', trim(unnest(cast(json(tags) as varchar[]))) from hist where record_status = 'Active')"""))
def browse_options(lab: Lab) -> DataFrame:
    return browse.options(lab.issues)


# exports, retention and invariants


@query(L.ledger(f"select occurrence_id, coalesce(owner, '') as owner, payload, cast(number as varchar) as number from (select * from hist order by first_seen_at, occurrence_id limit {export.MAX_ROWS + 1})"))
def export_csv(lab: Lab) -> DataFrame:
    return export.csv_rows(lab.issues, ["occurrence_id", "owner", "payload", "number"])


@query(L.ledger("""select occurrence_id, json_extract_string(payload, '$.user_id') as "record.user_id", json_extract_string(payload, '$.event_type') as "record.event_type",
    json_extract_string(payload, '$.band') as "record.band" from hist where record_status = 'Active'"""))
def export_expand(lab: Lab) -> DataFrame:
    fields = ["user_id", "event_type", "band"]
    return export.expanded(lab.issues.where("record_status = 'Active'"), fields).select("occurrence_id", *[F.col(f"`record.{f}`") for f in fields])


@query(L.base("""
select page_id, n_rows, n_bytes, cast(r as bigint) as rows_so_far, cast(b as bigint) as bytes_so_far from (
    select *, sum(n_rows) over w as r, sum(n_bytes) over w as b from (
        select 'page-' || strftime(ts, '%Y%m%d%H') as page_id, max(ts) as used_at, count(*) as n_rows, sum(length(props)) as n_bytes from events group by 1)
    window w as (order by used_at desc, page_id rows unbounded preceding))
where r <= 3000 and b <= 25000"""))
def page_cache_trim(lab: Lab) -> DataFrame:
    pages = lab.table("events").groupBy(F.concat(F.lit("page-"), F.date_format("ts", "yyyyMMddHH")).alias("page_id")).agg(
        F.max("ts").alias("used_at"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("props")).alias("n_bytes")
    )
    return retention.cached_pages(pages, 3000, 25_000).select("page_id", "n_rows", "n_bytes", "rows_so_far", "bytes_so_far")


@query(L.ledger("""
select coalesce(a.check_id, b.check_id) as check_id, coalesce(a.number, b.number) as number, a.n as before, b.n as after
from (select check_id, number, count(*) as n from occ1 group by all) a full join (select check_id, number, count(*) as n from occ group by all) b
    on a.check_id = b.check_id and a.number = b.number
where a.n is distinct from b.n"""))
def scenario_diff(lab: Lab) -> DataFrame:
    counted = lambda df, name: df.groupBy("check_id", "number").agg(F.count(F.lit(1)).alias(name))
    both = counted(lab.reviewed, "before").join(counted(lab.occurrences, "after"), ["check_id", "number"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


@query(L.ledger("""
select check_id, count(*) as n, count(distinct occurrence_id) as ids, count(*) filter (identity is null) as without_identity,
    count(*) filter (not (json_valid(payload) and payload like '{%' and payload <> '{}')) as without_record from occ group by check_id"""))
def snapshot_checks(lab: Lab) -> DataFrame:
    fields = F.size(F.map_keys(F.from_json("payload", "map<string,string>")))
    return lab.occurrences.groupBy("check_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("occurrence_id").alias("ids"),
        F.count_if(F.col("identity").isNull()).alias("without_identity"),
        F.count_if(F.coalesce(fields, F.lit(0)) <= 0).alias("without_record"),
    )


@query(L.base(f"""
, gone as (
    select check_id, invocation_id from execs where captured_at < timestamp '2024-01-20' and {L.USABLE} and n <= 28 and not (n = 12 and check_id = 'events.error'))
select o.check_id, o.invocation_id, count(*) as left_observations from obs o
where not exists (select 1 from gone g where g.check_id = o.check_id and g.invocation_id = o.invocation_id) group by all""".lstrip("\n")))
def raw_pruning(lab: Lab) -> DataFrame:
    started = lab.executions.where("n = 12 and check_id = 'events.error'")
    gone = retention.prunable(lab.executions, lab.receipts, started, F.expr("timestamp_ntz '2024-01-20'"))
    left = retention.without(lab.observations, gone)
    return left.groupBy("check_id", "invocation_id").agg(F.count(F.lit(1)).alias("left_observations"))


@query(L.ledger("select check_id, event_type, count(*) as n from ev where event_at >= timestamp '2024-01-15' group by all"))
def event_retention(lab: Lab) -> DataFrame:
    kept = retention.kept_since(lab.events, "event_at", F.expr("timestamp_ntz '2024-01-15'"))
    return kept.groupBy("check_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(L.ledger("select check_id, identity, scheme, count(*) as count from occ where record_status = 'Active' group by all having count(*) > 1"))
def invariant_one_active(lab: Lab) -> DataFrame:
    return apply.repeated_keys(lab.occurrences.where("record_status = 'Active'"), replay.KEY)


@query(L.ledger("select event_id, count(*) as count from ev group by all having count(*) > 1"))
def invariant_unique_ids(lab: Lab) -> DataFrame:
    return apply.repeated_keys(lab.events, ["event_id"])


@query(L.ledger("select occurrence_id, record_status from occ where record_status = 'Archived' and close_reason is null or archived_at < last_seen_at or first_seen_at > last_seen_at"))
def invariant_evidence(lab: Lab) -> DataFrame:
    bad = "record_status = 'Archived' and close_reason is null or archived_at < last_seen_at or first_seen_at > last_seen_at"
    return lab.occurrences.where(bad).select("occurrence_id", "record_status")
