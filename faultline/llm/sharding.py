"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash of the whole record.  Pass two puts each bucket into a fixed order, applies a
seeded Fisher-Yates shuffle, and writes it.  A record's place in the whole order is
its bucket's offset plus its place in the bucket, so shards are equal ranges of
places: row counts differ by one at most (the law ``rows``) and slots have no gaps.

The number of buckets follows from the data and ``bucket_bytes`` alone, so the same
records and seed give the same order on any cluster.  The driver holds one count
per bucket, 16 bytes for each ``bucket_bytes`` of text (48 MB for 100 TB).

Cases: a null text has size 1 and checksum 0.  A group of equal texts is scattered by
its ids and other columns, records of one id (or of none) by their texts; only
wholly equal records share a bucket, and they are interchangeable.  Columns that hold
maps are not part of the hash.  An empty table gives an empty table.  Other columns
pass through; columns named shard, slot, size or text_crc32 are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm._common import scratch_path, shuffles_freed, tune

_ADDED = ("size", "text_crc32", "shard", "slot")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of n places; place i swaps with one of i..n-1."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).random(max(n - 1, 0))
    picks = (np.arange(n - 1) + draws * (n - np.arange(n - 1))).astype(np.int64) if n > 1 else ()
    for i, j in enumerate(picks):
        order[i], order[j] = order[j], order[i]
    return order


def record_hash(docs: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 16,
    seed: int = 17,
    text: str = "text",
    bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """Write docs to path, partitioned by shard, each with its slot; return what was written."""
    spark = tune(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in _ADDED]
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    made = [F.col(f"`{c}`") for c in kept] + [(F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")]
    sized = docs.select(*made)
    total = docs.agg(F.sum(F.octet_length(raw))).first()[0] or 0
    buckets = max(shards, math.ceil(total / bucket_bytes))
    hash_name, bucket_name = unused(sized, "_hash"), unused(sized, "_bucket")
    bucket = F.pmod(record_hash(docs, seed), F.lit(buckets)).cast("int")
    counted = docs.groupBy(bucket.alias("b")).count().toArrow()
    sizes = np.zeros(buckets + 1, np.int64)
    sizes[counted["b"].to_numpy() + 1] = counted["count"].to_numpy()
    offsets = sizes.cumsum()
    rows = int(offsets[-1])
    starts = np.array([s * rows // shards for s in range(shards + 1)], np.int64)
    shared = spark.sparkContext.broadcast(offsets)
    schema = T.StructType(
        [*sized.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    )
    names = schema.fieldNames()

    def shuffle(key: tuple[pa.Scalar, ...], records: pa.Table) -> pa.Table:
        b = key[0].as_py()
        order = pc.sort_indices(records[hash_name])
        order = order.take(pa.array(fisher_yates(len(order), seed * 1_000_003 + b)))
        place = shared.value[b] + np.arange(len(order))
        shard = np.searchsorted(starts, place, side="right") - 1
        done = records.drop_columns([hash_name, bucket_name]).take(order)
        done = done.append_column("shard", pa.array(shard, pa.int32()))
        return done.append_column("slot", pa.array(place - starts[shard], pa.int64())).select(names)

    scattered = docs.select(
        *made,
        record_hash(docs, seed).alias(hash_name),
        bucket.alias(bucket_name),
    )
    with shuffles_freed(spark):
        scattered.groupBy(f"`{bucket_name}`").applyInArrow(shuffle, schema).write.partitionBy("shard").parquet(path)
    fields = [f for f in schema.fields if f.name != "shard"] + [schema["shard"]]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def shard_digest(docs: DataFrame) -> DataFrame:
    path = scratch_path(docs.sparkSession, "shards")
    return write_shards(docs.select("doc_id", "text"), path).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
