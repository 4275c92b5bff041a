"""Byte-level BPE encoding and decoding with a segment tree.

Each match of the split pattern is encoded on its own.  A segment tree over the
byte positions of a match stores the rank of the pair that starts at each live
position; the root is the smallest rank, and descending left-first finds its
leftmost position.  A merge updates the leaf of the merged token, of the token
before it and of the token it swallowed: three paths of logarithmic length.

Matches repeat a lot, so each worker keeps the ids of short ones in a bounded
cache.  The work is a narrow map: nothing is shuffled.

Cases: a null text is an empty text and has no ids.  Very long matches take
n log n steps.  Rows are independent, so repeated rows and ties need no rule;
an empty table gives an empty table; other columns pass through, and columns
that clash with an output name are replaced.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm._common import tune

_NONE = 1 << 62
_CACHE_ENTRIES, _CACHE_CHARS = 400_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the split pattern."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    width = 1 << max(0, (n - 2).bit_length())
    rank = ranks.get
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = rank(piece[i : i + 2], _NONE)
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(position: int, value: int) -> None:
        node = width + position
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a <= b else b
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while (low := tree[1]) != _NONE:
        node = 1
        while node < width:
            node *= 2
            if tree[node] != low:
                node += 1
        left = node - width
        right = after[left]
        end = after[right]
        after[left] = end
        before[end] = left
        if right < n - 1:
            put(right, _NONE)
        put(left, rank(piece[left : after[end]], _NONE) if end < n else _NONE)
        if (prior := before[left]) >= 0:
            put(prior, rank(piece[prior:end], _NONE))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Codec(dict):
    """Text to little-endian 32-bit ids and back; the dict itself is the cache of matches."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= _CACHE_CHARS:
            if len(self) >= _CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def shipped(df: DataFrame, path: str) -> str:
    """The name under which every executor finds the ranks, which the driver sends once."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def _mapped(df: DataFrame, source: str, outputs: dict[str, T.DataType], make) -> DataFrame:
    """df with columns made from one source column, batch by batch."""
    tune(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in outputs]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t) for c, t in outputs.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.columns[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *outputs])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("_source")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs plus n_tokens and token_ids (little-endian unsigned 32-bit)."""

    name = shipped(docs, path)

    def make(texts: pa.Array) -> list[pa.Array]:
        each = codec(SparkFiles.get(name), pattern).encode
        ids = [each(t or "") for t in texts.to_pylist()]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return _mapped(docs, text, {"n_tokens": T.LongType(), "token_ids": T.BinaryType()}, make)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """encoded plus decoded, the bytes that its token ids stand for."""

    name = shipped(encoded, path)

    def make(column: pa.Array) -> list[pa.Array]:
        each = codec(SparkFiles.get(name), pattern).decode
        return [pa.array([each(x or b"") for x in column.to_pylist()], pa.binary())]

    return _mapped(encoded, ids, {"decoded": T.BinaryType()}, make)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs plus n_tokens, token_ids and decoded: encode() and decode() in one worker, with one set of ranks."""

    name = shipped(docs, path)

    def make(texts: pa.Array) -> list[pa.Array]:
        both = codec(SparkFiles.get(name), pattern)
        ids = [both.encode(t or "") for t in texts.to_pylist()]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(both.decode, ids), pa.binary())]

    return _mapped(docs, text, {"n_tokens": T.LongType(), "token_ids": T.BinaryType(), "decoded": T.BinaryType()}, make)


def token_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    coded = round_trip(docs.select("doc_id", "text"), path, pattern)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
