"""Exact top-k search by integer inner product, block at a time.

Each component x becomes floor(256 * x), x as double; a term is a dimension.
Vectors are ordered by their strongest term, so that ranges of them, the blocks,
hold similar vectors.  A block keeps its vectors as rows (its forward index) and
each term's largest and least value.  The sum over the terms of the larger of
query value times largest and times least value bounds every score in the block.

Per query, blocks are visited by falling bound and scored through their forward
index until a bound falls below the k-th score; equal bounds are still visited,
since ties go to the smaller id.  The k-th score starts from the query's own block,
where its nearest rows are, and rises from block to block and batch to batch of a
task.  The index is read where it lies and never shuffled: queries travel to it, in
chunks of ``chunk_queries`` that are broadcast, one pass over the index for each
chunk.  Each task gives at most k rows a query, which are merged per query.

How much the bounds spare depends on the vectors.  Vectors with few strong
components are skipped by blocks; vectors that point evenly in all directions, like
the random ones of the test data, have no two that are near in every component, and
there all blocks are scored.

Cases: vectors that are null, or hold a null or non-finite component, and rows
with a null id take no part.  Vectors meet only vectors of their own length.  Rows
that share a query's id are its own and no candidates for it; of several
different vectors of one query id the least is the query.  Other repeated rows are
candidates each.  Scores beyond 64 bits are clamped.  Empty tables give an empty
table.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm._common import keep

_EXACT = 2**53
_MOST = 2**63 - 1


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


_BLOCK = "dim int, n int, ids binary, vectors binary, asks binary"


def _blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of one length as one row."""
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        asks: list[bool] = []

        def out() -> pa.RecordBatch:
            matrix = np.array(vectors, "<i8")
            packed = (np.array(ids, "<i8").tobytes(), matrix.tobytes(), np.array(asks, bool).tobytes())
            sizes = [pa.array([n], pa.int32()) for n in (matrix.shape[1], len(ids))]
            for held in (ids, vectors, asks):
                held.clear()
            return pa.RecordBatch.from_arrays([*sizes, *(pa.array([x], pa.binary()) for x in packed)], names=["dim", "n", "ids", "vectors", "asks"])

        for batch in batches:
            offsets, values = batch.columns[1].offsets.to_numpy(), batch.columns[1].values.to_numpy()
            for i, (row_id, ask) in enumerate(zip(batch.columns[0].to_pylist(), batch.columns[2].to_pylist(), strict=True)):
                vector = values[offsets[i] : offsets[i + 1]]
                if ids and (len(ids) >= rows or len(vector) != len(vectors[0])):
                    yield out()
                ids.append(row_id)
                vectors.append(vector)
                asks.append(bool(ask))
        if ids:
            yield out()

    return run


def unpacked(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    return np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["vectors"], "<i8").reshape(block["n"], block["dim"])


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products, clamped to 64 bits."""
    largest = [int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in (queries, vectors)]
    if largest[0] * largest[1] * max(queries.shape[1], 1) < _EXACT:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -_MOST - 1, _MOST).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, the sum over terms of the most that a vector of the block can add."""
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    return products(signed, np.hstack([high, low]))


class Search:
    """The k best rows so far of each of some queries of one length, and what they have to reach."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.least = least.copy()
        self.best = np.full((len(ids), k), -_MOST - 1)
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))  # query's place, score, row's id
        self.scored = self.pairs = 0

    def visit(self, blocks: list[dict]) -> None:
        held = [unpacked(b) for b in blocks]
        bound = bounds(self.queries, *(np.array([f(m, axis=0) for _, m in held]) for f in (np.max, np.min))) if self.queries.shape[1] else np.zeros((len(self.ids), len(held)), np.int64)
        order = np.argsort(bound, axis=1, kind="stable")[:, ::-1]
        self.pairs += bound.size
        for step in range(len(held)):
            block_of = order[:, step]
            open_ = bound[np.arange(len(self.ids)), block_of] >= self.least
            if not open_.any():
                break
            for b in np.unique(block_of[open_]):
                self._score(np.flatnonzero(open_ & (block_of == b)), *held[b])

    def _score(self, which: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.scored += len(which)
        scores = products(self.queries[which], vectors)
        valid = ids[None] != self.ids[which][:, None]
        top = np.where(valid, scores, -_MOST - 1)
        if len(ids) > self.k:
            top = np.partition(top, -self.k, axis=1)[:, -self.k :]
        self.best[which] = np.sort(np.hstack([self.best[which], top]), axis=1)[:, -self.k :]
        self.least[which] = np.maximum(self.least[which], self.best[which, 0])
        near = np.nonzero(valid & (scores >= self.least[which][:, None]))
        place, score, row = (np.concatenate(x) for x in zip(self.held, (which[near[0]], scores[near], ids[near[1]]), strict=True))
        if len(place) > 4 * self.k * len(self.ids):
            place, score, row = self._best_of(place, score, row)
        self.held = place, score, row

    def _best_of(self, place: np.ndarray, score: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((row, -score, place))
        place, score, row = place[order], score[order], row[order]
        first = np.searchsorted(place, place)
        kept = np.arange(len(place)) - first < self.k
        return place[kept], score[kept], row[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, row's id, score) of the k best of each query."""
        place, score, row = self._best_of(*self.held)
        return self.ids[place], row, score


def _seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, v, least): each query and the k-th score that its own block shows."""
        for batch in batches:
            for block in batch.to_pylist():
                asks = np.frombuffer(block["asks"], bool)
                if asks.any():
                    ids, vectors = unpacked(block)
                    own = Search(ids[asks], vectors[asks], np.full(int(asks.sum()), -_MOST - 1), k)
                    own.visit([block])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.ids), pa.array(own.queries.tolist(), pa.list_(pa.int64())), pa.array(own.least)], names=["id", "v", "least"]
                    )

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vector: str = "embedding",
    row_id: str = "vec_id",
    block_rows: int = 256,
    chunk_queries: int = 4096,
) -> DataFrame:
    """(query_id, rank, <row_id>, score): the k best of every query row."""
    good = vectors.where(F.col(row_id).isNotNull() & usable(F.col(vector))).select(
        F.col(row_id).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    strength = F.transform("v", lambda x: F.abs(x))
    place = F.array_position(strength, F.array_max(strength)).cast("int")
    ordered = good.select(
        "id", "v", "q", F.size("v").alias("dim"), F.coalesce(place * F.when(F.get("v", place - 1) < 0, -1).otherwise(1), F.lit(0)).alias("strongest")
    )
    index = keep(
        ordered.repartitionByRange("dim", "strongest", "id")
        .sortWithinPartitions("dim", "strongest", "id")
        .select("id", "v", "q")
        .mapInArrow(_blocks(block_rows), _BLOCK),
        "vector-blocks",
    )
    seeds = index.mapInArrow(_seeds(k), "id long, v array<long>, least long")
    asked = seeds.groupBy("id").agg(F.min(F.struct("v", F.bitwise_not("least").alias("r"))).alias("s"))
    queries = keep(asked.select("id", "s.v", F.bitwise_not("s.r").alias("least")), "vector-queries")
    chunks = max(1, -(-queries.count() // chunk_queries))
    found = None
    for c in range(chunks):
        part = keep(_searched(index, queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c), k), "vector-found")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.select("query_id", F.row_number().over(best).alias("rank"), F.col("id").alias(row_id), "score").where(F.col("rank") <= k)
    )


def _searched(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): what each task finds for one chunk of queries."""
    drawn = queries.toArrow().combine_chunks()
    by_length: dict[int, list[int]] = {}
    lists = drawn["v"].to_pylist()
    for i, v in enumerate(lists):
        by_length.setdefault(len(v), []).append(i)
    ids, least = drawn["id"].to_numpy(), drawn["least"].to_numpy()
    made = {n: (ids[at], np.array([lists[i] for i in at], np.int64).reshape(len(at), n), least[at]) for n, at in by_length.items()}
    shared = index.sparkSession.sparkContext.broadcast(made)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Search] = {}
        for batch in batches:
            blocks: dict[int, list[dict]] = {}
            for block in batch.to_pylist():
                blocks.setdefault(block["dim"], []).append(block)
            for n in blocks.keys() & shared.value.keys():
                if n not in open_:
                    open_[n] = Search(*shared.value[n], k)
                open_[n].visit(blocks[n])
        for done in open_.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done.found()], names=["query_id", "id", "score"])

    return index.mapInArrow(search, "query_id long, id long, score long")
