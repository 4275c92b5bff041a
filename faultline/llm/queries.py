"""The opN queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, decontam, lines, lmscore, minhash, secretscan, sharding, suffixes, topk, toxicity
from faultline.llm._common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
Query = Callable[[SparkSession, str], DataFrame]


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_digest(table(spark, sf_dir, "documents"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digest(table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_top_k_search": top_k,
    "op2_line_dedup": line_dedup,
    "op3_sharding": shards,
    "op4_toxicity": toxic,
    "op5_decontamination": decontamination,
    "op6_suffix_dedup": suffix_dedup,
    "op7_minhash_dedup": near_dedup,
    "op8_lm_scoring": lm_scores,
    "op9_byte_bpe": byte_bpe,
    "op10_secret_scan": secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k_search": """
with good as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from good q join good c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
    where q.vec_id % 50 = 0),
ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
    "op2_line_dedup": """
with line as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents),
keyed as (
    select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from line),
common as (
    select k, max(doc_id) as keeper from keyed where length(k) >= 20
    group by k having count(distinct doc_id) >= 3),
marked as (
    select keyed.*, common.k is not null and keyed.doc_id <> keeper as gone
    from keyed left join common on keyed.k = common.k)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op5_decontamination": decontam.ORACLE_SQL,
    "op6_suffix_dedup": suffixes.ORACLE_SQL,
    "op7_minhash_dedup": minhash.ORACLE_SQL,
    "op10_secret_scan": secretscan.ORACLE_SQL,
}
