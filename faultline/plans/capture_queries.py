"""Registered queries over the plain tables: identities, payloads and capture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.identity import canonical_identity, identity_hash, normalised, sha256_hex
from faultline.functions.payload import json_object
from faultline.operators import capture
from faultline.plans.lab_sql import prefixed
from faultline.sources.scratch import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GRAIN = ["l_orderkey", "l_linenumber"]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def failing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped before their order's date; the grain is not unique among them."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    joined = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.where("l_shipdate < o_orderdate").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), "l_returnflag",
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" owner"), (F.col("l_suppkey") % 5).cast("string"))).alias("row_owner"),
    )


_SUBJECT = f"""
bad as (
    select l_orderkey, l_linenumber, cast(l_quantity as decimal(18,2)) as quantity, l_returnflag,
        case when l_partkey % 3 = 0 then ' owner' || (l_suppkey % 5) end as row_owner
    from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate),
hashed as (
    select *, sha256('dqm-id-v1|k10:l_orderkey|' || {prefixed("cast(l_orderkey as varchar)")} || 'k12:l_linenumber|' || {prefixed("cast(l_linenumber as varchar)")}) as identity,
        cast(json_object('l_orderkey', cast(l_orderkey as varchar), 'l_linenumber', cast(l_linenumber as varchar), 'quantity', cast(quantity as varchar),
            'l_returnflag', l_returnflag, 'row_owner', row_owner) as varchar) as payload
    from bad),
per as (
    select identity, count(*) as row_count, min(payload) as payload, min(nullif(trim(row_owner), '')) as low, max(nullif(trim(row_owner), '')) as high
    from hashed group by identity)"""


@query(f"""
select c_custkey, 'dqm-id-v1|k6:c_name|' || {prefixed("lower(trim(c_name))")} || 'k4:note|n|' as preimage,
    sha256('dqm-id-v1|k6:c_name|' || {prefixed("lower(trim(c_name))")} || 'k4:note|n|') as identity,
    sha256('dqm-id-v1|k9:c_custkey|' || {prefixed("cast(c_custkey as varchar)")}) as by_key
from customer""")
def identity_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = {"c_name": normalised(F.col("c_name")), "note": F.lit(None).cast("string")}
    return _table(spark, sf_dir, "customer").select(
        "c_custkey",
        canonical_identity(pairs).alias("preimage"),
        identity_hash(pairs).alias("identity"),
        identity_hash({"c_custkey": normalised(F.col("c_custkey"))}).alias("by_key"),
    )


@query("""
select n_nationkey, 'dqm-id-v1|' || string_agg('k' || length(k) || ':' || k || '|', '' order by i) as scheme, '["' || string_agg(k, '","' order by i) || '"]' as granularity
from (select n_nationkey, unnest([lower(trim(n_name)), 'key' || n_regionkey]) as k, unnest([1, 2]) as i from nation) group by n_nationkey""")
def scheme_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of grains that are data: the same formats, as expressions."""
    grain = F.array(F.lower(F.trim("n_name")), F.concat(F.lit("key"), F.col("n_regionkey").cast("string")))
    part = lambda k: F.concat(F.lit("k"), F.length(k).cast("string"), F.lit(":"), k, F.lit("|"))
    return _table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat(F.lit("dqm-id-v1|"), F.array_join(F.transform(grain, part), "")).alias("scheme"), F.to_json(grain).alias("granularity")
    )


@query("""
select doc_id, cast(json_object('doc_id', cast(doc_id as varchar), 'quality', cast(quality as varchar), 'nothing', null) as varchar) as payload,
    sha256(cast(json_object('doc_id', cast(doc_id as varchar), 'quality', cast(quality as varchar), 'nothing', null) as varchar)) as digest
from labels where toxic = 1""")
def record_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("doc_id", F.col("doc_id").cast("string")), ("quality", F.col("quality").cast("string")), ("nothing", F.lit(None).cast("string"))]
    made = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", json_object(pairs).alias("payload"))
    return made.select("*", sha256_hex(F.col("payload")).alias("digest"))


@query(f"with {_SUBJECT} select identity, payload, l_orderkey, l_linenumber from hashed order by identity, payload limit 500")
def capture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.bounded_sample(failing_lines(spark, sf_dir), GRAIN, 500).select("identity", "payload", *GRAIN)


@query(f"""with {_SUBJECT}
select identity, row_count, payload, case when low <> high then 'team' else coalesce(low, 'team') end as owner, coalesce(low <> high, false) as owner_conflict from per""")
def capture_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = capture.bounded_sample(failing_lines(spark, sf_dir), GRAIN, None)
    return capture.observations(sample, F.col("row_owner"), "team")


@query(f"""with {_SUBJECT}, s as (
    select cast(sum(row_count) as bigint) as raw_rows, count(*) as issues, count(*) filter (low <> high) as owner_conflicts from per)
select s.*, c.check_id, case when c.reported <> raw_rows then 'collection_error' when c.cap is not null and raw_rows >= c.cap then 'limit_reached' else 'success' end as status
from s, (values ('no limit', (select count(*) from bad), null), ('small limit', (select count(*) from bad), 100), ('wrong count', -1, null)) c(check_id, reported, cap)""")
def capture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = kept(capture.bounded_sample(failing_lines(spark, sf_dir), GRAIN, None), "staged")
    stats = capture.capture_stats(capture.observations(staged, capture.row_owner(staged, "ROW_OWNER"), "team"))
    counted = staged.agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[F.struct(F.lit(a).alias("check_id"), b.alias("reported"), F.lit(c).cast("long").alias("cap")) for a, b, c in (("no limit", F.col("n"), None), ("small limit", F.col("n"), 100), ("wrong count", F.lit(-1).cast("long"), None))])
    both = stats.join(counted.select(F.explode(cases).alias("c")))  # one row beside three
    status = capture.collection_status(F.col("raw_rows"), F.col("c.reported"), F.col("c.cap"), F.lit(False))
    return both.select("raw_rows", "issues", "owner_conflicts", "c.check_id", status.alias("status"))


for _registry in (QUERIES, ORACLE_SQL):
    _registry["identity_hash"] = _registry.pop("identity_hash_query")
