"""What a replay shuffles and sorts, and its states against a plain loop."""

from datetime import datetime

from pyspark.sql import functions as F

from faultline.operators import apply, reconcile, replay
from faultline.sources.store import Ledger

RUNS = [(1, "limit_reached"), (2, "success"), (3, "success"), (4, "limit_reached"), (5, "success"), (6, "success"), (7, "limit_reached")]
SEEN = {"a": {1: "p", 2: "q", 4: "r", 6: "s"}, "b": {4: "p"}, "c": {}, "d": {2: "p", 7: "q"}, "e": {3: "o", 4: "p"}, "f": {99: "x"}}
OPEN = {"a": "o", "c": "o", "e": "o"}


def tables(spark):
    executions = spark.createDataFrame(
        [("k", f"i{n:02}", datetime(2024, 1, n), status, None if n == 5 else "s", "low", "[]") for n, status in RUNS],
        "check_id string, invocation_id string, captured_at timestamp_ntz, status string, scheme string, priority string, tags string",
    )
    observations = spark.createDataFrame(
        [("k", f"i{n:02}", i, None if i == "d" else "s", p, 1, "me") for i, rows in SEEN.items() for n, p in rows.items()],
        "check_id string, invocation_id string, identity string, scheme string, payload string, row_count long, owner string",
    )
    history = spark.createDataFrame([{"occurrence_id": f"o-{i}", "check_id": "k", "identity": i, "scheme": "s", "number": 2, "payload": p, "record_status": "Active"} for i, p in OPEN.items()], replay.OCCURRENCE)
    return executions, observations, history


def by_loop():
    for i, rows in SEEN.items():
        was, before, episode = i in OPEN, OPEN.get(i), 0
        for n, status in RUNS:
            failing = n in rows
            if not failing and status == "limit_reached":
                continue
            episode += failing and not was
            yield i, f"i{n:02}", failing, was, before, failing and not was, episode, rows.get(n), "o-" + i if i in OPEN else None
            was, before = failing, rows.get(n)


def of(states):
    names = ("identity", "invocation_id", "failing", "was_failing", "was_payload", "starts", "episode", "payload", "open_id")
    return sorted(map(repr, map(tuple, states.select(*names).collect())))


def test_states_equal_a_plain_loop(spark):
    found = list(by_loop())
    assert of(replay.states(*tables(spark))) == sorted(map(repr, found))
    assert of(replay.states(*tables(spark), only_considered=True)) == sorted(repr(s) for s in found if s[2] or s[3])


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_states_are_neither_shuffled_nor_sorted_once_made(spark):
    """F1, F3, F5, F7, F8, F9: only what was observed moves, and once."""
    executions, observations, history = tables(spark)
    for considered in (False, True):
        above, made, _ = plan(replay.states(executions, observations, history, considered)).partition("Generate inline")
        assert made and "Exchange hashpartitioning" not in above and "Sort " not in above
    states = replay.states(executions, observations, history, True)
    changes = replay.occurrences(states, history)
    assert plan(changes).count("Exchange hashpartitioning(check_id") <= 5  # executions in three small forms, observations, history
    stored = spark.createDataFrame(changes.limit(0).collect(), changes.schema)
    above, made, _ = plan(replay.lifecycle_events(states, stored, history)).partition("Generate inline")
    assert made and above.count("Exchange hashpartitioning(check_id") == 0


def test_a_merge_shuffles_each_side_once(spark):
    """the rows of the target and those of the changes meet in one join."""
    old = tables(spark)[2].repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(apply.merged(old, old.withColumn("number", F.lit(3))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning(occurrence_id") == 2


def test_rows_that_the_target_has_are_not_grouped(spark):
    """what is there already goes before the rows of a key are reduced to one."""
    rows = spark.createDataFrame([("a", "2"), ("b", "2"), ("b", "1")], "id string, x string")
    new = apply.insert_new(rows.where("id = 'a'").repartition(2), rows, ["id"])
    assert [tuple(r) for r in new.collect()] == [("b", "1")]
    text = plan(new)
    assert 0 <= text.index("Aggregate") < text.index("LeftAnti")


def test_a_run_stores_neither_states_nor_events_twice(spark, tmp_path, monkeypatch):
    """states are made where they are used, and events are written once, by the commit."""
    names = []
    monkeypatch.setattr(reconcile, "kept", lambda rows, name: names.append(name) or rows)
    ledger, now = Ledger(spark, f"file://{tmp_path}/ledger"), F.expr("timestamp_ntz '2024-02-01'")
    ledger.create(reconcile.TABLES)
    executions, observations, _ = tables(spark)
    found = {"executions": executions.withColumn("result", F.lit("fail")), "observations": observations}
    ledger.commit(ledger.manifest(), append={t: reconcile.shaped(rows, t) for t, rows in found.items()})
    tracked = executions.select("check_id").distinct()
    reconcile.change_set(ledger, reconcile.freeze(ledger, tracked, "r", now), tracked, "r", now)
    assert names == ["reconcile-history", "reconcile-changes"]
