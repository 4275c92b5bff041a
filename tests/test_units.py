"""Functions, checks, capture, storage, review, retention, browsing, exports and streams on small data."""

import hashlib
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from faultline.functions import identity, payload, scalars
from faultline.operators import apply, browse, capture, collect, export, maintenance, reconcile, replay, retention, review, views
from faultline.plans.checks import Check, Registry, by_outcome
from faultline.sources.seeds import read_seed
from faultline.sources.store import Ledger, Migration, Stale
from faultline.streaming.capture import captured_stream

GOLDEN = [
    ([("customer_id", None)], "0169b9347fcfe450d3c8ea1f771cb7386263b0e99782fb382ff1580f357d4508"),
    ([("customer_id", "  C-1  ")], "02fa0e4a646bab426ef41aa78da9373808bf74fad4def119ef3938007ac0f5e2"),
    ([("city", "münchen")], "3ec9dee83fe54a8498e002582bb8a3a7141019e7c4b200c52513f3d2ec61f586"),
    ([("name", "o'neil\"\\")], "a835c12ca50e41fe9c76ab96c717cec07c748ded6f1adc7b95b2a128e8fe58ac"),
    ([("customer_id", "c-1"), ("order_id", "o-9")], "cc07d4db5139d14437fb9ded1d15c3728d98945105077c051cc27af2b4795131"),
    ([("order_id", "o-9"), ("customer_id", "c-1")], "dfc33030e97e9b9e6678f077f2d618bfc3330f543b19f9161b3e7bebebdd8b2b"),
]


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_identity_vectors(spark):
    made = [identity.identity_hash({k: identity.normalised(F.lit(v).cast("string")) for k, v in pairs}) for pairs, _ in GOLDEN]
    assert one(spark, *made) == [h for _, h in GOLDEN]


def test_signatures():
    assert identity.scheme_signature([" Customer_ID", "x"]) == "dqm-id-v1|k11:customer_id|k1:x|"
    assert identity.granularity_signature([" A", "b "]) == '["a","b"]'
    assert identity.canonical_signature('["a"]') == identity.canonical_signature("dqm-id-v1|k1:a|") == "dqm-id-v1|k1:a|"
    for bad in ([], ["a", "A "], ["a", 1], [" "]):
        with pytest.raises(ValueError):
            identity.grain_of(bad)


@pytest.mark.parametrize(
    "before,after,keys,changed",
    [
        ('{"a":"1","b":"2"}', '{"b":"2","a":"1"}', None, False),
        ('{"a":"1"}', '{"a":"2","c":null}', "a,c", True),
        ('{"a":null}', "{}", "a", True),
        ('{"z":"1","a":"1"}', '{"z":"2","a":"2"}', "a,z", True),
        (None, "{}", None, True),
        (None, None, None, False),
    ],
)
def test_changed_keys(spark, before, after, keys, changed):
    b, a = (F.lit(x).cast("string") for x in (before, after))
    got = one(spark, payload.changed_keys(b, a), payload.payload_changed(b, a))
    assert got[1] is changed and (before is None or got[0] == keys)


def test_payload_of_any_type(spark):
    row = spark.sql("select 1 as n, cast(null as string) as gone, array(1, 2) as l, struct('x' as y) as s, cast('ab' as binary) as raw")
    assert row.select(payload.record_payload(row)).first()[0] == '{"n":"1","gone":null,"l":"[1,2]","s":"{\\"y\\":\\"x\\"}","raw":"YWI="}'


def test_scalars(spark):
    assert one(spark, scalars.safe_rate(F.lit(1), F.lit(0)), scalars.safe_rate(F.lit(1), F.lit(4))) == [None, 0.25]
    hour = scalars.hours_between(F.expr("timestamp_ntz '2024-01-01 00:59:00'"), F.expr("timestamp_ntz '2024-01-01 01:01:00'"))
    assert one(spark, hour, scalars.priority_rank(F.lit("HIGH")), scalars.priority_rank(F.lit(None).cast("string"))) == [1, 1, 4]
    tags = lambda t: scalars.has_tag(F.lit(t).cast("string"), ["ops"])
    assert one(spark, tags('["x"," ops "]'), tags("[oops"), tags(None)) == [True, False, False]
    guard = [one(spark, scalars.formula_guarded(F.lit(x)))[0] for x in ("=1", "  +2", "\tx", "plain", "a=b")]
    assert guard == ["'=1", "'  +2", "'\tx", "plain", "a=b"]
    assert scalars.day_bounds(date(2024, 3, 31), date(2024, 3, 31), "Europe/Berlin") == (datetime(2024, 3, 30, 23), datetime(2024, 3, 31, 22))
    assert scalars.owner_text([" a ", "", "b"]) == "a, b" and scalars.owner_text(" ") is None
    with pytest.raises(ValueError):
        scalars.owner_text(3)
    taken = set()
    names = [scalars.sheet_name("a/b:" + "x" * 40, "id", taken) for _ in range(3)]
    assert len({n.casefold() for n in names}) == 3 and all(len(n) <= 31 for n in names)


def test_checks(spark):
    good = Check("c1", "select 1 as id", ("id",), priority="High ")
    assert not good.problems(["ID"]) and good.scheme == "dqm-id-v1|k2:id|"
    bad = {
        "grain": Check("x", "", ()), "repeat": Check("x", "", ("a", " A")), "missing": Check("x", "", ("b",)), "priority": Check("x", "", ("a",), priority="huge"),
        "limit": Check("x", "", ("a",), limit=0), "calc": Check("x", "", ("a",), settings={"fail_calc": "sum(x)"}), "view": Check("x", "", ("a",), settings={"storage": "view"}),
        "key": Check("x", "", ("a",), settings={"owner": "z"}), "owner": Check("x", "", ("a",), owner=[1]), "criticality": Check("x", "", ("a",), criticality=3),
        "unknown": Check("x", "", ("a",), settings={"old": 1}),
    }
    assert all(c.problems(["a"]) for c in bad.values())
    registry = Registry([good, Check("c2", "select 2 as id", ("id",))])
    assert [c.check_id for c in registry.select(exclude=["c1"])] == ["c2"] and registry.tracked(spark).count() == 2
    assert by_outcome([("pass", "a"), ("fail", "z"), ("fail", "b"), ("error", "q")]) == [("error", "q"), ("fail", "b"), ("fail", "z"), ("pass", "a")]


def test_capture_collapses_and_bounds(spark):
    rows = spark.createDataFrame([(" A", 1, "x"), ("a", 2, "y"), ("b", 3, " x "), ("c", 4, None), (None, 5, None)], "id string, n int, o string")
    sample = capture.bounded_sample(rows, ["id"], None)
    got = {r.row_count: r for r in capture.observations(sample, F.col("o"), "team").where("row_count = 2 or owner = 'x'").collect()}
    assert got[2].owner == "team" and got[2].owner_conflict and got[1].owner == "x"
    assert capture.bounded_sample(rows, ["id"], 2).count() == 2
    status = [one(spark, capture.collection_status(*(F.lit(x).cast("long") for x in v[:3]), F.lit(v[3])))[0] for v in ((3, 4, None, False), (0, 0, 5, True), (5, 5, 5, False), (0, 0, 5, False))]
    assert status == ["collection_error", "not_applicable", "limit_reached", "success"]


EXECUTION = "check_id string, invocation_id string, captured_at timestamp_ntz, status string, scheme string, priority string, tags string"
OBSERVATION = "check_id string, invocation_id string, identity string, scheme string, payload string, row_count long, owner string"


def evidence(spark, runs, seen):
    """runs: (n, status, scheme); seen: {n: {identity: value}}; all of check c."""
    executions = [("c", f"i{n:02}", datetime(2024, 1, n), status, scheme, "low", "[]") for n, status, scheme in runs]
    schemes = {n: s for n, _, s in runs}
    found = [("c", f"i{n:02}", i, schemes[n], f'{{"v":"{v}"}}', 1, "o") for n, rows in seen.items() for i, v in rows.items()]
    return spark.createDataFrame(executions, EXECUTION), spark.createDataFrame(found, OBSERVATION)


def run_all(spark, executions, observations, splits):
    """Replay in batches that end at the given invocations; (occurrences, events)."""
    ledger = spark.createDataFrame([], replay.OCCURRENCE)
    events, begin = [], ""
    for end in splits:
        inside = (F.col("invocation_id") > begin) & (F.col("invocation_id") <= end)
        states = replay.states(executions.where(inside), observations.where(inside), ledger)
        changes = replay.occurrences(states, ledger)
        events += replay.lifecycle_events(states, changes, ledger, still_failing=True).collect()
        ledger = spark.createDataFrame(apply.merged(ledger, changes.drop("episode")).collect(), replay.OCCURRENCE)
        begin = end
    return sorted(map(str, ledger.collect())), sorted((e.event_id, e.event_type, e.invocation_id) for e in events), ledger


def test_replay_semantics(spark):
    runs = [(1, "success", "s1"), (2, "success", "s1"), (3, "success", "s1"), (4, "limit_reached", "s1"), (5, "success", "s1"), (6, "success", "s2")]
    seen = {1: {"a": 1, "b": 1}, 2: {"a": 2, "b": 1}, 3: {"b": 1}, 4: {"a": 3}, 5: {"a": 3, "b": 1}, 6: {"z": 1}}
    executions, observations = evidence(spark, runs, seen)
    occurrences, events, ledger = run_all(spark, executions, observations, ["i06"])
    found = {(r.identity, r.number): (r.record_status, r.close_reason) for r in ledger.collect()}
    assert found == {("a", 1): ("Archived", "Passed"), ("a", 2): ("Archived", "IDENTITY_CHANGED"), ("b", 1): ("Archived", "IDENTITY_CHANGED"), ("z", 1): ("Active", None)}
    assert Counter(t for _, t, _ in events) == {"APPEARED": 3, "REAPPEARED": 1, "VALUES_CHANGED": 1, "DISAPPEARED": 1, "CLOSED_STRUCTURAL": 2, "STILL_FAILING": 4}
    for splits in (["i01", "i02", "i03", "i04", "i05", "i06"], ["i03", "i06"]):
        assert run_all(spark, executions, observations, splits)[:2] == (occurrences, events)


def test_replay_of_null_schemes(spark):
    """A null scheme meets a null scheme: it is observed, closed by absence as structural, and never lost."""
    runs = [(1, "success", None), (2, "success", None), (3, "success", None), (4, "success", "s1"), (5, "success", "s1")]
    executions, observations = evidence(spark, runs, {1: {"a": 1, "b": 1}, 2: {"a": 2}, 3: {"a": 2, "b": 1}, 4: {"z": 2}, 5: {"z": 2}})
    occurrences, events, ledger = run_all(spark, executions, observations, ["i05"])
    found = {(r.identity, r.scheme, r.number): (r.record_status, r.close_reason) for r in ledger.collect()}
    assert found == {
        ("a", None, 1): ("Archived", "IDENTITY_CHANGED"), ("b", None, 1): ("Archived", "IDENTITY_CHANGED"),
        ("b", None, 2): ("Archived", "IDENTITY_CHANGED"), ("z", "s1", 1): ("Active", None),
    }
    assert Counter(t for _, t, _ in events) == {"APPEARED": 4, "VALUES_CHANGED": 1, "STILL_FAILING": 2, "DISAPPEARED": 1, "CLOSED_STRUCTURAL": 2}
    assert run_all(spark, executions, observations, ["i01", "i03", "i04", "i05"])[:2] == (occurrences, events)


def test_collect_reconcile_and_review(spark, tmp_path):
    """From a check's rows to reviewed occurrences, with the guards on the way."""
    now = F.expr("timestamp_ntz '2024-02-01'")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.create(reconcile.TABLES)
    made = lambda rows, **more: Check("c", lambda s: s.createDataFrame(rows, "id string, v int, Row_Owner string"), ("id",), name="C", owner="team", call_to_action="look", **more)
    at = lambda n: F.expr(f"timestamp_ntz '2024-01-0{n} 00:00:00'")
    assert collect.collect(ledger, made([("A", 1, None), ("a", 2, "x"), ("b", 1, " y ")]), "i1", at(1)) == "success"
    assert collect.collect(ledger, made([("a", 1, None)]), "i2", at(2), reported=5, project_owner="p") == "collection_error"
    assert collect.collect(ledger, Check("bad", "select 1 as v", ("id",)), "i1", at(1)) == "configuration_error"
    assert ledger.read("observations").where("invocation_id = 'i2'").isEmpty() and ledger.read("executions").count() == 3
    tracked = spark.createDataFrame([("c",)], "check_id string")
    reconcile.reconcile(ledger, tracked, "r1", now)
    rows = {r.owner: r for r in ledger.read("occurrences").collect()}
    assert {o: (r.record_status, r.row_count, r.call_to_action, r.check_name, r.version) for o, r in rows.items()} == {"x": ("Active", 2, "look", "C", 0), "y": ("Active", 1, "look", "C", 0)}
    assert [(r["owner"], r["new"], r["opened"]) for r in views.run_summary(ledger, "r1")] == [("x", 1, 1), ("y", 1, 1), ("Unassigned", 0, 0)]

    # reviewers edit while a run is under way; the replay keeps what they own, and the run goes on top of it
    assert collect.collect(ledger, made([("b", 7, None)]), "i3", at(3)) == "success"
    frozen = reconcile.freeze(ledger, tracked, "r2", now)
    edits = [review.Patch(rows["x"].occurrence_id, "workflow_status", "TRIAGED", 0), review.Patch(rows["x"].occurrence_id, "notes", "known", 0)]
    patches = spark.createDataFrame([(p.occurrence_id, p.field_name, p.new_value, p.base_version) for p in edits], "occurrence_id string, field_name string, new_value string, base_version int")
    batch = review.batch_id(edits)
    after, audit = review.applied(ledger.read("occurrences"), patches, batch, now)
    ledger.commit(ledger.manifest(), replace={"occurrences": reconcile.shaped(after, "occurrences")}, append={"changes": reconcile.shaped(audit, "changes")})
    assert review.refuse_partial(ledger.read("changes"), batch, 2)
    with pytest.raises(RuntimeError):
        review.refuse_partial(ledger.read("changes"), batch, 3)
    again, none = review.applied(ledger.read("occurrences"), patches, batch, now, ledger.read("changes"))
    assert none.isEmpty() and sorted(map(str, again.collect())) == sorted(map(str, ledger.read("occurrences").collect()))
    reconcile.abandon(ledger, "r2")
    reconcile.reconcile(ledger, tracked, "r3", now)
    got = {r.identity: r for r in ledger.read("occurrences").collect()}
    x, y = got[rows["x"].identity], got[rows["y"].identity]
    assert (x.record_status, x.workflow_status, x.test_status, x.notes, x.version, x.workflow_at_close) == ("Archived", "TRIAGED", "TRIAGED", "known", 1, "TRIAGED")
    assert y.record_status == "Active" and y.payload == '{"id":"b","v":"7","Row_Owner":null}'
    assert {r.run_id: r.status for r in ledger.read("runs").collect()} == {"r1": "completed", "r2": "abandoned", "r3": "completed"}
    assert ledger.manifest()["generation"] == 2 and frozen["generation"] == 1
    with pytest.raises(RuntimeError):
        views.run_summary(ledger, "r1")
    # late evidence is refused, and whoever froze before another run's commit is refused too
    assert collect.collect(ledger, made([]), "i0", F.expr("timestamp_ntz '2023-12-31'")) == "success"
    with pytest.raises(ValueError, match="late evidence: c/i0"):
        reconcile.reconcile(ledger, tracked, "r4", now)
    for table, keys in reconcile.KEYS.items():
        assert apply.repeated_keys(ledger.read(table), keys).isEmpty(), table


def test_maintenance_of_a_ledger(spark, tmp_path):
    now, day = F.expr("timestamp_ntz '2024-02-01'"), lambda n: datetime(2024, 1, n)
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.create(reconcile.TABLES)
    made = lambda rows: Check("c", lambda s: s.createDataFrame(rows, "id string"), ("id",))
    for n, rows in ((2, [("a",)]), (3, []), (4, [("a",)])):
        collect.collect(ledger, made(rows), f"i{n}", F.lit(day(n)).cast("timestamp_ntz"))
    tracked = spark.createDataFrame([("c",)], "check_id string")
    reconcile.reconcile(ledger, tracked, "r1", now)
    assert maintenance.verified_snapshot(ledger)[0].count() == 2

    # what comes too late can be skipped, but nothing else
    collect.collect(ledger, made([("z",)]), "i1", F.lit(day(1)).cast("timestamp_ntz"))
    some = lambda *ids: spark.createDataFrame([("c", i) for i in ids], "check_id string, invocation_id string")
    for bad in (some("i1", "i1"), some("i2"), some("unknown")):
        with pytest.raises(ValueError):
            maintenance.skip_late(ledger, bad, now)
    maintenance.skip_late(ledger, some("i1"), now)
    assert ledger.read("events").where("event_type = 'EVIDENCE_SKIPPED'").count() == 1
    assert reconcile.reconcile(ledger, tracked, "r2", now)["generation"] == 3 and ledger.read("occurrences").count() == 2

    # pruning: the mark never goes back, started runs hold their inputs
    assert maintenance.prune_raw(ledger, day(4))["raw_pruned_before"] == "2024-01-04T00:00:00"
    assert [r.invocation_id for r in ledger.read("executions").collect()] == ["i4"] and ledger.read("observations").count() == 1
    assert maintenance.prune_raw(ledger, day(2))["raw_pruned_before"] == "2024-01-04T00:00:00"
    maintenance.keep_since(ledger, {"events": ("event_at", day(4)), "runs": ("started_at", datetime(2024, 3, 1))})
    assert ledger.read("runs").isEmpty() and {r.event_type for r in ledger.read("events").collect()} == {"REAPPEARED", "EVIDENCE_SKIPPED"}

    # schema: verified, migrated once, and started over
    ledger.verify(reconcile.TABLES, reconcile.KEYS)
    step = Migration("one", {"occurrences": {"area": "string"}}, {("occurrences", "area"): F.concat(F.lit("a-"), "check_id")}, lambda t: apply.require_none(t["occurrences"].where("area is null"), "no area"))
    assert ledger.migrate([step]) == ["one"] and ledger.migrate([step]) == []
    assert {r.area for r in ledger.read("occurrences").collect()} == {"a-c"}
    failing = Migration("two", {"events": {"x": "int"}}, {}, lambda t: apply.require_none(t["events"], "not yet"))
    with pytest.raises(ValueError):
        ledger.migrate([failing])
    assert ledger.manifest()["migrations"] == ["one"]
    before = ledger.views("my_")
    assert spark.sql("select count(*) from my_occurrences").first()[0] == 2
    after = ledger.refresh(reconcile.TABLES)
    assert ledger.read("occurrences").isEmpty() and after["installation_id"] != before["installation_id"]
    frames, manifest = ledger.snapshot("occurrences")
    assert frames["occurrences"].isEmpty() and manifest["generation"] == after["generation"]
    with pytest.raises(RuntimeError):
        ledger.verify({"other": "x int"}, {})


def test_seeds_and_metrics(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,amount\na,1.50\nb,\n")
    assert [tuple(map(str, r)) for r in read_seed(spark, str(tmp_path / "s.csv"), "id string, amount decimal(18,2)").collect()] == [("a", "1.50"), ("b", "None")]
    maintenance.write_metrics({"b": 1, "a": datetime(2024, 1, 1)}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text() == '{\n "a": "2024-01-01 00:00:00",\n "b": 1\n}\n'


def test_invariants_show_planted_violations(spark):
    row = ("o", "c", "i", None, "Active")
    rows = spark.createDataFrame([row, row], "occurrence_id string, check_id string, identity string, scheme string, record_status string")
    assert apply.repeated_keys(rows.where("record_status = 'Active'"), replay.KEY).count() == 1
    with pytest.raises(ValueError):
        apply.require_none(apply.repeated_keys(rows, ["occurrence_id"]), "twice")
    new = apply.insert_new(rows.limit(0), spark.createDataFrame([("o", "c", "2", None, "x"), ("o", "c", "1", None, "x")], rows.schema), ["occurrence_id"])
    assert [r.identity for r in new.collect()] == ["1"]
    runs = spark.createDataFrame([("a", "started", datetime(2024, 1, 1)), ("b", "started", datetime(2024, 1, 2))], "run_id string, status string, started_at timestamp_ntz")
    assert {r.run_id: r.status for r in apply.abandoned(runs, F.expr("timestamp_ntz '2024-01-02 00:10:00'"), 30).collect()} == {"a": "abandoned", "b": "started"}


@pytest.mark.parametrize("mode", ["full", "changed_columns", "none"])
def test_payload_modes(spark, mode):
    events = spark.createDataFrame([("e", "VALUES_CHANGED", '{"a":"1"}', '{"a":"2"}')], "event_id string, event_type string, previous_payload string, payload string")
    r = replay.event_payloads(events, mode).first()
    assert (r.payload is not None) == (mode == "full") and (r.digest is not None) == (mode != "none")
    assert r.changed_columns == (None if mode == "none" else "a")


def test_apply_keeps_what_reviewers_own(spark):
    runs = [(1, "success", "s1"), (2, "success", "s1")]
    executions, observations = evidence(spark, runs, {1: {"a": 1, "b": 1}, 2: {"b": 2}})
    first = spark.createDataFrame(run_all(spark, executions, observations, ["i01"])[2].withColumn("workflow_status", F.lit("TRIAGED")).collect(), replay.OCCURRENCE)
    later = F.col("invocation_id") == "i02"
    states = replay.states(executions.where(later), observations.where(later), first)
    again = apply.merged(first, replay.occurrences(states, first.withColumn("workflow_status", F.lit("NEW"))).drop("episode"))
    got = {r.identity: (r.workflow_status, r.record_status, r.workflow_at_close) for r in again.collect()}
    assert got == {"a": ("TRIAGED", "Archived", "TRIAGED"), "b": ("TRIAGED", "Active", None)}
    with pytest.raises(ValueError, match="late evidence: c/i01"):
        apply.refuse_late(executions.where("invocation_id = 'i01'"), apply.high_water(executions))


def test_store(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.create({"t": "id int", "log": "x string"})
    base = ledger.manifest()
    assert ledger.read("t").isEmpty()
    one_ = spark.createDataFrame([(1,)], "id int")
    ledger.commit(base, replace={"t": one_}, append={"log": spark.createDataFrame([("a",)], "x string")}, new_generation=True)
    with pytest.raises(Stale):
        ledger.commit(base, replace={"t": one_})
    second = ledger.manifest()
    ledger.commit(second, append={"log": spark.createDataFrame([("b",)], "x string")})
    assert ledger.read("log").count() == 2 and ledger.read("log", second).count() == 1
    assert ledger.rebased(second, lambda m: {"append": {"t": one_}})["version"] == 3 and ledger.read("t").count() == 2
    with pytest.raises(Stale):
        ledger.rebased(base, lambda m: {})
    assert ledger.manifest()["generation"] == 1


def test_review(spark):
    with pytest.raises(ValueError):
        review.validated([review.Patch("o", "owner", "a", 1), review.Patch("o", "owner", "b", 1)])
    with pytest.raises(ValueError):
        review.validated([review.Patch("o", "owner", "a", 1), review.Patch("o", "verdict", "UNREVIEWED", 2)])
    with pytest.raises(ValueError):
        review.validated([review.Patch("o", "number", "a", 1)])
    edits = [review.Patch("o", "owner", "a", 1), review.Patch("o", "verdict", "TRUE_POSITIVE", 1)]
    assert review.batch_id(edits) == review.batch_id(edits[::-1])
    occurrences = spark.createDataFrame([("o", 1, "NEW", None, "UNREVIEWED"), ("p", 2, "NEW", "x", "UNREVIEWED")], "occurrence_id string, version int, workflow_status string, owner string, verdict string")
    patches = spark.createDataFrame([("o", "owner", "a", 1), ("p", "owner", "b", 1), ("q", "owner", "c", 1)], "occurrence_id string, field_name string, new_value string, base_version int")
    assert {r.occurrence_id for r in review.conflicts(occurrences, patches).collect()} == {"p", "q"}
    after, audit = review.applied(occurrences, patches, "b1", F.expr("timestamp_ntz '2024-01-01'"))
    assert {(r.occurrence_id, r.version, r.owner) for r in after.collect()} == {("o", 2, "a"), ("p", 2, "x")}
    assert [(r.occurrence_id, r.old_value, r.new_value) for r in audit.collect()] == [("o", None, "a")]
    with pytest.raises(ValueError):
        review.missed_issue("m", "t", "bad luck", "2024-01-01", "s")
    assert review.missed_issue("m", "t", "no_test", "2024-01-01", area_label="z")["area_label"] == "z"


def test_maintenance_steps():
    log = []

    def bad():
        raise KeyError("x")

    assert retention.run_steps({"a": bad, "b": lambda: None}, log.append) == {"a": "failed", "b": "succeeded"}
    assert log[0]["diagnostic_id"] and log[0]["error"] == "KeyError" and log[1]["outcome"] == "succeeded"
    with pytest.raises(RuntimeError):
        retention.run_steps({"a": bad}, log.append, strict=True)


#: name: (log rows (invocation, outcome, logged, marker, kind), triggers (invocation, marker), state)
STATES = {
    "no_outcome": ([], [("r1", 1)], "unknown"),
    "success": ([("r1", "succeeded", 2, 1, "automatic")], [("r1", 1)], "ok"),
    "earlier_success_newer_missing": ([("r1", "succeeded", 2, 1, "automatic")], [("r1", 1), ("r2", 3)], "unknown"),
    "later_success_supersedes": ([("r2", "succeeded", 4, 3, "automatic")], [("r1", 1), ("r2", 3)], "ok"),
    "tie_with_missing": ([("r1", "succeeded", 2, 1, "automatic")], [("r1", 1), ("r2", 1)], "unknown"),
    "tie_with_failure": ([("r1", "succeeded", 2, 1, "automatic"), ("r2", "failed", 2, 1, "automatic")], [("r1", 1), ("r2", 1)], "failing"),
    "conflicting": ([("r1", "succeeded", 2, 1, "automatic"), ("r1", "failed", 3, 1, "automatic")], [("r1", 1)], "unknown"),
    "failure_only": ([("r1", "failed", 2, 1, "automatic")], [("r1", 1)], "failing"),
    "failure_then_missing": ([("r1", "failed", 2, 1, "automatic")], [("r1", 1), ("r2", 3)], "unknown"),
    "out_of_order": ([("r2", "succeeded", 4, 3, "automatic"), ("r1", "failed", 9, 1, "automatic")], [("r1", 1), ("r2", 3)], "ok"),
    "unattributed_only": ([("r1", "succeeded", 2, None, None)], [("r1", 1)], "unknown"),
    "unattributed_superseded": ([("r0", "failed", 1, None, None), ("r1", "succeeded", 2, 1, "automatic")], [("r1", 1)], "ok"),
    "unattributed_after_success": ([("r1", "succeeded", 2, 1, "automatic"), ("r2", "failed", 5, None, None)], [("r1", 1)], "unknown"),
    "manual_then_new_trigger": ([("m", "succeeded", 2, None, "manual")], [("r1", 1), ("r2", 3)], "unknown"),
    "manual_after_triggers": ([("m", "succeeded", 5, None, "manual")], [("r1", 1), ("r2", 3)], "ok"),
    "pruned_triggers": ([("r1", "succeeded", 2, 1, "automatic")], [], "ok"),
}


def test_maintenance_states(spark):
    at = lambda n: None if n is None else datetime(2024, 1, 1, n)
    for name, (rows, marks, state) in STATES.items():
        log = spark.createDataFrame([("s", i, o, at(l), at(m), k, "d") for i, o, l, m, k in rows], "step string, invocation_id string, outcome string, logged_at timestamp_ntz, trigger_marker_at timestamp_ntz, trigger_kind string, diagnostic_id string")
        triggers = spark.createDataFrame([(i, at(m)) for i, m in marks], "invocation_id string, marker_at timestamp_ntz")
        steps = spark.createDataFrame([("s",)], "step string")
        assert [r.state for r in views.maintenance_health(steps, log, triggers).collect()] == [state], name


def test_pages_cover_everything_once(spark):
    rows = [(f"o{i:03}", "Active", "high" if i % 3 else None, datetime(2024, 1, 1 + i % 4)) for i in range(60)]
    issues = spark.createDataFrame(rows, "occurrence_id string, record_status string, priority string, first_seen_at timestamp_ntz")
    seen, after = [], None
    while True:
        page = browse.page_keys(issues, browse.Filters(), 25, after).collect()
        seen += [r.occurrence_id for r in page[:25]]
        if len(page) <= 25:
            break
        after = (page[24]["rank"], page[24].first_seen_at, page[24].occurrence_id)
    assert sorted(seen) == [r[0] for r in rows] and len(seen) == 60
    with pytest.raises(ValueError):
        browse.page_keys(issues, browse.Filters(), 0)


def test_exports(spark, tmp_path):
    issues = spark.createDataFrame([("o", "=1", '{"a":"12345678901234567890.10","b":null}', datetime(2024, 1, 1))], "occurrence_id string, owner string, payload string, first_seen_at timestamp_ntz")
    assert export.field_names(issues) == ["a", "b"]
    assert export.expanded(issues, ["a", "b"]).first()["record.a"] == "12345678901234567890.10"
    numbers = issues.withColumn("payload", F.lit('{"a":1.5,"b":{"c":[1]}}'))
    assert list(export.expanded(numbers, ["a", "b"]).select("`record.a`", "`record.b`").first()) == ["1.5", '{"c":[1]}']
    with pytest.raises(Exception, match="twice"):
        export.expanded(issues.withColumn("payload", F.lit('{"a":"1","a":"2"}')), ["a"]).collect()
    out = tmp_path / "x.csv"
    assert export.write_csv(export.csv_rows(issues, ["occurrence_id", "owner"]), str(out)) == 1
    assert out.read_bytes().startswith(b"\xef\xbb\xbf") and "'=1" in out.read_text("utf-8-sig")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("A",), ("a",), ("b",)], "id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    stream = captured_stream(spark.readStream.schema("id string").parquet(str(tmp_path / "in")), Check("c", "", ("id",)), lambda run, rows: got.update({run: rows.collect()}))
    query = stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert list(got) == ["epoch-0000000000"] and sorted(r.row_count for r in got["epoch-0000000000"]) == [1, 2]


def test_hashes_match_python(spark):
    assert one(spark, identity.sha256_hex(F.lit("é")))[0] == hashlib.sha256("é".encode()).hexdigest()
