"""Replay: successive executions of checks become episodes of failing records.

Inputs (pure DataFrames):

* executions: check_id, invocation_id, captured_at, status, scheme, priority, tags, and what ``RUN_TEXTS`` names
* observations: check_id, invocation_id, identity, scheme, payload, row_count, owner, call_to_action
* history: all occurrences so far of the identities at hand (``OCCURRENCE``)

Every candidate meets the executions of its check.  A state counts as failing if
the execution observed the candidate; an execution that hit its limit says
nothing about candidates that it did not observe.  All windows, rollups and joins
share the partition (check, identity): one exchange of what was observed, and the
states that candidates make with executions are neither shuffled nor sorted.

A scheme may be null, and null meets null: joins, windows and rollups use
``SCHEME_KEY``, a text that tells a null from every scheme.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.identity import event_id, occurrence_id, payload_digest
from faultline.functions.payload import changed_keys, payload_changed

KEY = ["check_id", "identity", "scheme"]
SCHEME_KEY = "_scheme"
#: KEY with a scheme that is never null, so that plain equality is null-safe.
MATCH = ["check_id", "identity", SCHEME_KEY]
#: What all of a replay is partitioned by: a record under whatever scheme.
RECORD = ["check_id", "identity"]
OCCURRENCE = (
    "occurrence_id string, check_id string, identity string, scheme string, number int, payload string, row_count long, tags string,"
    " priority string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, archived_at timestamp_ntz, record_status string,"
    " close_reason string, first_invocation string, last_seen_invocation string, last_invocation string, workflow_status string,"
    " owner string, verdict string, version int, workflow_at_close string, check_name string, source_id string, source_name string,"
    " severity string, test_status string, call_to_action string, ticket_url string, notes string, annotated_at timestamp_ntz,"
    " granularity string, criticality string"
)
#: What an execution says of its check; a column that is missing is null.
RUN_TEXTS = ("check_name", "source_id", "source_name", "severity", "granularity", "criticality")
_COLUMNS = [part.split()[0] for part in OCCURRENCE.split(",")]


def _text(rows: DataFrame, name: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None).cast("string")).alias(name)


def keyed(rows: DataFrame) -> DataFrame:
    """rows with SCHEME_KEY."""
    return rows.withColumn(SCHEME_KEY, F.coalesce(F.concat(F.lit("="), F.col("scheme")), F.lit("")))


def scheme_of(key: str = SCHEME_KEY) -> Column:
    return F.when(F.col(key) != "", F.substring(key, 2, 2**31 - 1)).alias("scheme")


def candidates(observations: DataFrame, active: DataFrame) -> DataFrame:
    return observations.select(*KEY).unionByName(active.select(*KEY)).distinct()


def _ranked(executions: DataFrame) -> DataFrame:
    """The executions of each check in order: at, counted from 1, and how many that speak of what they did not observe come before it and up to it."""
    order = Window.partitionBy("check_id").orderBy("captured_at", "invocation_id")
    speaks = F.coalesce(F.col("status") != "limit_reached", F.lit(False))
    upto = F.sum(speaks.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return (
        executions.select(
            "check_id", "invocation_id", "captured_at", "status", F.col("scheme").alias("run_scheme"), "priority", "tags",
            *[_text(executions, c) for c in RUN_TEXTS], F.row_number().over(order).alias("at"), upto.alias("n_upto"),
            speaks.alias("speaks"), (upto - speaks.cast("int")).alias("n_before"),
        )
    )


def states(executions: DataFrame, observations: DataFrame, history: DataFrame, only_considered: bool = False) -> DataFrame:
    """One row per candidate and execution, with what came before it; only_considered: considered() of them, without making the others.

    Only observations and open occurrences are shuffled and sorted, once and by RECORD.
    The executions of a batch are broadcast; a candidate's states between two
    observations are known from their places among the executions of its check.
    """
    runs = _ranked(executions)
    place = ("at", "n_before", "n_upto")
    quiet = runs.groupBy("check_id").agg(F.array_sort(F.collect_list(F.when(F.col("speaks"), F.col("at")))).alias("quiet"))
    seen = (
        keyed(observations)
        .join(F.broadcast(runs.select("check_id", "invocation_id", *place)), ["check_id", "invocation_id"], "left")
        .select(*MATCH, *[F.coalesce(c, F.lit(0)).alias(c) for c in place], "payload", "row_count", "owner", _text(observations, "call_to_action"), F.lit(None).cast("string").alias("opened"))
    )
    prior = keyed(history.where("record_status = 'Active'")).select(
        *MATCH, *[F.lit(0).alias(c) for c in place], "payload", F.lit(None).cast("long").alias("row_count"),
        *[F.lit(None).cast("string").alias(c) for c in ("owner", "call_to_action")], F.col("occurrence_id").alias("opened"),
    )
    w = Window.partitionBy(*MATCH).orderBy("at", "opened")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fails = (F.col("at") > 0) | F.col("opened").isNotNull()
    # nothing that speaks lies between this observation and the failure before it
    goes_on = F.coalesce(F.lag(fails).over(w) & (F.lag("n_upto").over(w) >= F.col("n_before")), F.lit(False))
    known = lambda c: F.last(F.when(F.col("opened").isNotNull(), F.col(c)), True).over(so_far)
    marked = (
        seen.unionByName(prior)
        .repartition(*RECORD)
        .select(
            "*", fails.alias("fails"), goes_on.alias("goes_on"), F.lag("payload").over(w).alias("before"), (F.row_number().over(w) == 1).alias("is_first"),
            F.lead("n_before").over(w).alias("next_before"), known("opened").alias("open_id"), known("payload").alias("open_payload"),
        )
        .withColumn("episode", F.sum(((F.col("at") > 0) & ~F.col("goes_on")).cast("int")).over(so_far).cast("int"))
        .join(F.broadcast(quiet), "check_id")
    )
    state = lambda at, failing, was: F.struct(at.alias("at"), failing.alias("failing"), was.alias("was_failing"))
    no, none = F.lit(False), F.array().cast("array<struct<at:int,failing:boolean,was_failing:boolean>>")
    own = F.when(F.col("at") > 0, F.array(state(F.col("at"), F.lit(True), F.col("goes_on")))).otherwise(none)
    absences = F.greatest(F.coalesce("next_before", F.size("quiet")) - F.col("n_upto"), F.lit(0))
    if only_considered:
        made = F.concat(own, F.when(F.col("fails") & (absences > 0), F.array(state(F.get("quiet", F.col("n_upto")), no, F.lit(True)))).otherwise(none))
    else:
        later = F.transform(F.slice("quiet", F.col("n_upto") + 1, absences), lambda at, i: state(at, no, F.col("fails") & (i == 0)))
        sooner = F.when(F.col("is_first"), F.transform(F.slice("quiet", F.lit(1), F.col("n_before")), lambda at: state(at, no, no))).otherwise(none)
        made = F.concat(sooner, own, later)
    failing = F.col("failing")
    while_failing = lambda c: F.when(failing, F.col(c)).alias(c)
    return (
        marked.select(*MATCH, F.col("at").alias("observed_at"), "payload", "row_count", "owner", "call_to_action", "before", "open_id", "open_payload", "episode", F.inline(made))
        .join(F.broadcast(runs.drop("n_upto", "n_before", "speaks")), ["check_id", "at"])
        .select(
            *MATCH, scheme_of(), "invocation_id", "captured_at", "status", "run_scheme", "priority", "tags", *RUN_TEXTS,
            *[while_failing(c) for c in ("payload", "row_count", "owner", "call_to_action")], "failing", "open_id", "open_payload", "was_failing",
            F.when(F.col("was_failing"), F.when(failing, F.col("before")).otherwise(F.col("payload"))).alias("was_payload"),
            (failing & ~F.col("was_failing")).alias("starts"),
            F.when(F.col("at") < F.col("observed_at"), 0).otherwise(F.col("episode")).alias("episode"),
        )
    )


def considered(state: DataFrame) -> DataFrame:
    """States that belong to an episode, up to its first absence."""
    return state.where("failing or was_failing")


def episodes(state: DataFrame) -> DataFrame:
    """First and last failure, first absence and last execution of each episode."""
    at = F.struct("captured_at", "invocation_id")
    failing, absent = F.when(F.col("failing"), at), F.when(~F.col("failing"), at)
    here = F.struct("captured_at", "invocation_id", "payload", "row_count", "owner", "call_to_action", "run_scheme", "priority", "tags", *RUN_TEXTS)
    return (
        considered(state)
        .groupBy(*MATCH, "episode")
        .agg(
            F.min_by(here, failing).alias("first"),
            F.max_by(here, failing).alias("last"),
            F.min_by(here, absent).alias("absence"),
            F.max_by(here, at).alias("run"),
            F.count_if("failing").alias("n_failing"),
        )
        .withColumn("scheme", scheme_of())
    )


def occurrences(state: DataFrame, history: DataFrame) -> DataFrame:
    """The new and changed occurrences that the states make of the history."""
    open_ = F.struct(SCHEME_KEY, *[c for c in _COLUMNS if c not in KEY])
    past = keyed(history).groupBy(*RECORD).agg(
        F.max("number").alias("highest"), F.collect_list(F.when(F.col("record_status") == "Active", open_)).alias("open")
    )
    met = (
        episodes(state)
        .join(past, RECORD, "left")
        .withColumn("open", F.get(F.filter("open", lambda o: o[SCHEME_KEY] == F.col(SCHEME_KEY)), F.lit(0)))
    )
    old = F.col("episode") == 0
    kept = lambda c, new: F.when(old, F.col("open")[c]).otherwise(new)
    last = lambda c, field: F.when(old, F.coalesce(F.col("last")[field], F.col("open")[c])).otherwise(F.col("last")[field])
    first = lambda c: F.coalesce(F.col("first")[c], F.col("open")[c]).alias(c)
    null = F.lit(None).cast("string")
    closed = F.col("absence").isNotNull()
    same = F.col("scheme") == F.col("absence.run_scheme")  # a null scheme is never known to be the same
    reason = F.when(closed, F.when(same, "Passed").otherwise("IDENTITY_CHANGED"))
    return met.select(
        kept("occurrence_id", occurrence_id(F.col("check_id"), F.col("identity"), F.col("first.invocation_id"))).alias("occurrence_id"),
        *KEY,
        kept("number", F.coalesce("highest", F.lit(0)) + F.col("episode")).cast("int").alias("number"),
        last("payload", "payload").alias("payload"),
        last("row_count", "row_count").cast("long").alias("row_count"),
        F.col("run.tags").alias("tags"),
        F.col("run.priority").alias("priority"),
        kept("first_seen_at", F.col("first.captured_at")).alias("first_seen_at"),
        last("last_seen_at", "captured_at").alias("last_seen_at"),
        F.col("absence.captured_at").alias("archived_at"),
        F.when(closed, "Archived").otherwise("Active").alias("record_status"),
        reason.alias("close_reason"),
        kept("first_invocation", F.col("first.invocation_id")).alias("first_invocation"),
        last("last_seen_invocation", "invocation_id").alias("last_seen_invocation"),
        F.col("run.invocation_id").alias("last_invocation"),
        kept("workflow_status", F.lit("NEW")).alias("workflow_status"),
        kept("owner", F.col("first.owner")).alias("owner"),
        kept("verdict", F.lit("UNREVIEWED")).alias("verdict"),
        kept("version", F.lit(0)).cast("int").alias("version"),
        F.when(closed, kept("workflow_status", F.lit("NEW"))).alias("workflow_at_close"),
        *[first(c) for c in ("check_name", "source_id", "source_name", "severity")],
        kept("test_status", F.lit("NEW")).alias("test_status"),
        kept("call_to_action", F.col("first.call_to_action")).alias("call_to_action"),
        kept("ticket_url", null).alias("ticket_url"),
        kept("notes", null).alias("notes"),
        kept("annotated_at", F.lit(None).cast("timestamp_ntz")).alias("annotated_at"),
        first("granularity"),
        F.col("run.criticality").alias("criticality"),
        "episode",
    )


def lifecycle_events(state: DataFrame, changed: DataFrame, history: DataFrame, still_failing: bool = False) -> DataFrame:
    """One immutable event for each change of state.  ``changed`` comes from occurrences()."""
    closings = keyed(history).select(
        *MATCH, "number", "close_reason", F.lit(1).alias("late"), F.lit(None).cast("int").alias("episode"), F.lit(None).cast("string").alias("occurrence_id")
    ).unionByName(keyed(changed).select(*MATCH, "number", "close_reason", F.lit(2).alias("late"), "episode", "occurrence_id"))
    before = Window.partitionBy(*MATCH).orderBy("number").rangeBetween(-1, -1)
    one = F.struct("occurrence_id", F.col("close_reason").alias("own_reason"), "closed_before")
    own = (
        closings.repartition(*RECORD)
        .withColumn("closed_before", F.max_by("close_reason", "late").over(before))
        .where("late = 2")
        .groupBy(*MATCH)
        .agg(F.map_from_entries(F.collect_list(F.struct("episode", one))).alias("own"))
        .groupBy(*RECORD)
        .agg(F.map_from_entries(F.collect_list(F.struct(SCHEME_KEY, "own"))).alias("own"))
    )
    ends = ~F.col("failing") & F.col("was_failing")
    kind = (
        F.when(F.col("starts"), F.when(F.col("closed_before") == "Passed", "REAPPEARED").otherwise("APPEARED"))
        .when(ends, F.when(F.col("scheme").eqNullSafe(F.col("run_scheme")), "DISAPPEARED").otherwise("CLOSED_STRUCTURAL"))
        .when(F.col("failing") & payload_changed(F.col("was_payload"), F.col("payload")), "VALUES_CHANGED")
    )
    kind = kind.when(F.col("failing"), "STILL_FAILING") if still_failing else kind
    return (
        considered(state)
        .join(own, RECORD)
        .withColumn("own", F.try_element_at(F.try_element_at("own", F.col(SCHEME_KEY)), F.col("episode")))
        .where("own is not null")
        .select("*", "own.*")
        .withColumn("event_type", kind)
        .where("event_type is not null")
        .select(
            event_id(*[F.col(c) for c in ("check_id", "occurrence_id", "invocation_id", "event_type")]).alias("event_id"),
            "check_id",
            "occurrence_id",
            "identity",
            "invocation_id",
            F.col("captured_at").alias("event_at"),
            "event_type",
            F.when(F.col("was_failing"), F.col("was_payload")).alias("previous_payload"),
            F.coalesce("payload", "was_payload").alias("payload"),
            F.when(ends, F.col("own_reason")).alias("reason"),
        )
    )


def event_payloads(events: DataFrame, mode: str) -> DataFrame:
    """What the event ledger keeps of payloads: full, changed_columns or none."""
    if mode not in ("full", "changed_columns", "none"):
        raise ValueError(f"unknown payload mode {mode!r}")
    null = F.lit(None).cast("string")
    some = lambda c: null if mode == "none" else c
    before, after = F.col("previous_payload"), F.col("payload")
    # made before the payloads are cut: a name that the same projection gives anew may shadow the column
    made = events.select(
        "*",
        F.lit(mode).alias("payload_mode"),
        some(F.when(F.col("event_type") == "VALUES_CHANGED", changed_keys(before, after))).alias("changed_columns"),
        some(payload_digest(before)).alias("previous_digest"),
        some(payload_digest(after)).alias("digest"),
    )
    return made if mode == "full" else made.withColumn("previous_payload", null).withColumn("payload", null)


def removed_checks(history: DataFrame, tracked: DataFrame, now: Column, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Active occurrences of checks that are tracked no longer, archived, and their events."""
    gone = history.where("record_status = 'Active'").join(tracked.select("check_id"), "check_id", "left_anti")
    closed = (
        gone.withColumn("archived_at", now)
        .withColumn("record_status", F.lit("Archived"))
        .withColumn("close_reason", F.lit("TEST_REMOVED"))
        .withColumn("workflow_at_close", F.col("workflow_status"))
        .select(*_COLUMNS)
    )
    kind = F.lit("CLOSED_STRUCTURAL")
    events = gone.select(
        event_id(F.col("check_id"), F.col("occurrence_id"), F.lit(run_id), kind).alias("event_id"),
        "check_id",
        "occurrence_id",
        "identity",
        F.lit(run_id).alias("invocation_id"),
        now.alias("event_at"),
        kind.alias("event_type"),
        F.col("payload").alias("previous_payload"),
        "payload",
        F.lit("TEST_REMOVED").alias("reason"),
    )
    return closed, events
