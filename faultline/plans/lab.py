"""A ledger made from the ``events`` table, on which the registered queries run.

Each event type is a check that runs once a day; the users with such an event on
a day are its failing records.  Some runs hit their limit, some collect nothing,
one
check changes its grain, and one has no known scheme for a while.  Days 1 to 15 are replayed first and then
reviewed, days 16 to 28 next; days 29 and 30 wait.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.identity import identity_hash, scheme_signature
from faultline.functions.payload import json_object
from faultline.functions.scalars import usable
from faultline.operators import apply, replay, views
from faultline.sources.scratch import kept

DAYS = 30
USER, USER_AND_TYPE = scheme_signature(["user_id"]), scheme_signature(["user_id", "event_type"])


def now() -> Column:
    """The instant that all views of the lab are seen from."""
    return F.expr("timestamp_ntz '2024-02-01 06:30:00'")


def _scheme() -> Column:
    kind, n = F.col("event_type"), F.col("n")
    unknown = (kind == "purchase") & n.between(5, 18)
    return F.when(unknown, F.lit(None)).when((kind == "view") & (n >= 20), USER_AND_TYPE).otherwise(USER)


def _status() -> Column:
    n, kind = F.col("n"), F.col("event_type")
    return (
        F.when((kind == "signup") & (n % 13 == 5), "collection_error")
        .when((kind == "error") & (n == 29), "pending")
        .when(kind.isin("click", "view") & (n % 10 == 7), "limit_reached")
        .otherwise("success")
    )


def review(occurrences: DataFrame) -> DataFrame:
    """What reviewers are taken to have said, by the identity's first two digits."""
    one, two = F.substring("identity", 1, 1), F.substring("identity", 2, 1)
    return (
        occurrences.withColumn("workflow_status", F.when(one <= "2", "RESOLVED").when(one <= "4", "ACCEPTED_RISK").when(one == "5", "BLOCKED").otherwise("NEW"))
        .withColumn("verdict", F.when(two <= "4", "TRUE_POSITIVE").when(two <= "6", "FALSE_POSITIVE").otherwise("UNREVIEWED"))
        .withColumn("version", F.when(one <= "5", 1).otherwise(0))
        .withColumn("workflow_at_close", F.when(F.col("record_status") == "Archived", F.col("workflow_status")))
    )


class Lab:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        """All that was observed, with day n of the run."""
        daily = (
            self.table("events")
            .groupBy("event_type", "user_id", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("row_count"), (F.max("event_id") % 3).cast("string").alias("band"))
            .withColumn("n", F.dayofmonth("day"))
        )
        user, kind = F.col("user_id").cast("string"), F.col("event_type")
        both = identity_hash({"user_id": user, "event_type": kind})
        identity = F.when(_scheme() == USER_AND_TYPE, both).otherwise(identity_hash({"user_id": user}))
        seen = daily.where((_status() == "success") | ((_status() == "limit_reached") & (F.col("user_id") % 2 == 0)))
        found = seen.select(
            F.concat(F.lit("events."), kind).alias("check_id"),
            self._invocation().alias("invocation_id"),
            identity.alias("identity"),
            _scheme().alias("scheme"),
            json_object([("user_id", user), ("event_type", kind), ("band", F.col("band"))]).alias("payload"),
            "row_count",
            F.when(F.col("user_id") % 4 == 0, "alice").when(F.col("user_id") % 4 == 1, " bob ").alias("owner"),
            F.concat(F.lit("ask "), kind, F.when(F.col("n") % 2 == 0, " today").otherwise(" soon")).alias("call_to_action"),
            "n",
        )
        return kept(found, "observations")

    def _invocation(self) -> Column:
        return F.concat(F.lit("run-"), F.date_format("day", "yyyyMMdd"))

    @cached_property
    def executions(self) -> DataFrame:
        days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))
        runs = self.table("events").select("event_type").distinct().select("event_type", days.alias("day")).withColumn("n", F.dayofmonth("day"))
        runs = runs.select(
            F.concat(F.lit("events."), F.col("event_type")).alias("check_id"),
            self._invocation().alias("invocation_id"),
            F.date_add("day", 1).cast("timestamp_ntz").alias("captured_at"),
            "n",
            _status().alias("status"),
            _scheme().alias("scheme"),
            F.when(F.col("n") % 9 == 0, F.lit(None)).when(F.col("event_type") == "error", "critical").otherwise("medium").alias("priority"),
            F.concat(F.lit('["'), "event_type", F.lit('"," ops "]')).alias("tags"),
            F.concat(F.lit("Check "), "event_type", F.when(F.col("n") > 20, " v2").otherwise("")).alias("check_name"),
            F.lit("raw.events").alias("source_id"),
            F.concat(F.lit("db.raw."), "event_type").alias("source_name"),
            F.when(F.col("n") % 5 == 0, "warn").otherwise("error").alias("severity"),
            F.when(_scheme() == USER_AND_TYPE, '["user_id","event_type"]').when(_scheme() == USER, '["user_id"]').alias("granularity"),
            F.when(F.col("n") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), (F.col("n") % 3).cast("string"))).alias("criticality"),
        )
        failures = self.observations.groupBy("check_id", "invocation_id").agg(F.count(F.lit(1)).alias("failure_count"))
        found = F.coalesce("failure_count", F.lit(0))
        made = runs.join(failures, ["check_id", "invocation_id"], "left").select(
            *runs.columns,
            found.alias("failure_count"),
            F.when(F.col("n") % 3 == 0, 1).otherwise(0).alias("owner_conflicts"),
            F.when(found == 0, "pass").when(F.col("check_id") == "events.view", "warn").otherwise("fail").alias("result"),
        )
        return kept(made, "executions")

    @cached_property
    def tracked(self) -> DataFrame:
        kinds = self.table("events").select("event_type").distinct().where("event_type <> 'signup'")
        name = F.col("event_type")
        return kinds.select(F.concat(F.lit("events."), name).alias("check_id"), name.alias("check_name"), F.lit("error").alias("severity"))

    def batch(self, first: int, last: int) -> tuple[DataFrame, DataFrame]:
        between = F.col("n").between(first, last)
        return self.executions.where(usable() & between), self.observations.where(between)

    @cached_property
    def receipts(self) -> DataFrame:
        return self.batch(1, 28)[0].select("check_id", "invocation_id", F.lit("applied").alias("outcome"))

    @cached_property
    def nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], replay.OCCURRENCE)

    @cached_property
    def first_states(self) -> DataFrame:
        return replay.states(*self.batch(1, 15), self.nothing)

    @cached_property
    def first_considered(self) -> DataFrame:
        return replay.states(*self.batch(1, 15), self.nothing, only_considered=True)

    @cached_property
    def first_changes(self) -> DataFrame:
        return kept(replay.occurrences(self.first_considered, self.nothing), "first-changes")

    @cached_property
    def reviewed(self) -> DataFrame:
        return review(self.first_changes.drop("episode"))

    @cached_property
    def second_states(self) -> DataFrame:
        return replay.states(*self.batch(16, 28), self.reviewed)

    @cached_property
    def second_considered(self) -> DataFrame:
        return replay.states(*self.batch(16, 28), self.reviewed, only_considered=True)

    @cached_property
    def second_changes(self) -> DataFrame:
        return kept(replay.occurrences(self.second_considered, self.reviewed), "changes")

    @cached_property
    def occurrences(self) -> DataFrame:
        return kept(apply.merged(self.reviewed, self.second_changes.drop("episode")), "occurrences")

    @cached_property
    def first_events(self) -> DataFrame:
        return replay.lifecycle_events(self.first_considered, self.first_changes, self.nothing)

    @cached_property
    def second_events(self) -> DataFrame:
        return replay.lifecycle_events(self.second_considered, self.second_changes, self.reviewed)

    @cached_property
    def stored_events(self) -> tuple[DataFrame, DataFrame]:
        """The events of both batches, each made once."""
        return kept(self.first_events, "first-events"), kept(self.second_events, "second-events")

    @cached_property
    def events(self) -> DataFrame:
        first, second = self.stored_events
        return first.unionByName(second)

    @cached_property
    def missed(self) -> DataFrame:
        """Every customer stands for a missed issue."""
        c = self.table("customer")
        key = F.col("c_custkey")
        return c.select(
            F.concat(F.lit("missed-"), key.cast("string")).alias("missed_id"),
            F.when(key % 100 == 0, "events.error").otherwise("events.click").alias("check_id"),
            F.when(key % 150 == 0, F.lit(None)).otherwise(F.concat(F.lit("area."), (key % 3).cast("string"))).alias("source_id"),
            F.when(key % 150 == 0, F.col("c_mktsegment")).alias("area_label"),
            (now() - F.make_dt_interval((key % 60).cast("int"))).alias("discovered_at"),
        )

    @cached_property
    def issues(self) -> DataFrame:
        return views.history(self.occurrences)

    @cached_property
    def health(self) -> DataFrame:
        skipped = self.late_skips[0].select("check_id", "event_at", "event_type")
        kinds = self.events.select("check_id", "event_at", "event_type").unionByName(skipped)
        return views.check_health(
            self.tracked, self.occurrences, self.executions, self.receipts, kinds, self.missed, now(), F.expr("timestamp_ntz '2024-01-05'")
        )

    @cached_property
    def late_skips(self) -> tuple[DataFrame, DataFrame]:
        """Runs of days 10 to 12, had their receipts been lost."""
        some = self.executions.where("n between 10 and 12")
        known = self.receipts.join(some.select("check_id", "invocation_id"), ["check_id", "invocation_id"], "left_anti")
        return apply.skip_late(some, self.executions, known, apply.high_water(self.batch(1, 28)[0]), now())
