"""MinHash near-dedup: one-permutation hashing with optimal densification.

A document's set holds its distinct five-word shingles, as 64-bit hashes.  The
hash range is cut into ``BINS`` bins; a bin's value is the least hash in it, and
an empty bin borrows from the first non-empty bin in its own random order.  Six
bins make a band; documents that share a band's hash share a bucket.

Documents with equal sets are one class, kept by its smallest id.  In each bucket
the candidate pairs form a star around the bucket's hub, the class that shares
most buckets, so a bucket gives one pair per member and not all pairs.  Pairs are
confirmed on their full sets.  Members that these links leave outside their hub's
component then meet all members of the star in blocks of bounded size, and only
links between components leave a block, so that no similar pair that shares a
bucket is lost.  Components follow from the confirmed links.

Cases: a text that is null or without words has an empty set and is linked with
nothing.  With fewer than five words, the whole sequence is the one shingle.
Rows that share an id are one document, linked with each other.  A null id
counts as the smallest id.  The smallest id decides ties.  An empty table gives
an empty table.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._common import NULL_ID, UPPER, id_key, keep, passing
from faultline.llm.components import components

WORDS, BINS, ROWS = 5, 192, 6
BANDS = BINS // ROWS
_BLOCK_ROWS, _BLOCK_SHINGLES, _COLUMNS = 256, 1 << 20, 4096
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_RANDOM = np.random.default_rng(7)
_MULTIPLIERS = _RANDOM.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MULTIPLIERS = _RANDOM.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_OFFSETS = _RANDOM.integers(0, 2**63, BANDS, np.uint64)
_EDGES = np.array([(i << 64) // BINS for i in range(1, BINS)], np.uint64)
#: For each bin, the order in which it looks for a non-empty one.
_ORDER = np.array([_RANDOM.permutation(BINS) for _ in range(BINS)])


class WordHashes(dict):
    """Hashes of words, in a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += each[j : n - width + 1 + j] * _MULTIPLIERS[j]
    return np.unique(mix(total))


def band_hashes(sets: np.ndarray) -> np.ndarray:
    if not len(sets):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.searchsorted(sets, _EDGES)))
    full = starts < np.append(starts[1:], len(sets))
    values = sets[np.minimum(starts, len(sets) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    bands = (mix(values).reshape(BANDS, ROWS) * _BAND_MULTIPLIERS).sum(axis=1, dtype=np.uint64)
    return mix(bands + _BAND_OFFSETS).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, prints, bands = [], [], []
        for text in batch.columns[1].to_pylist():
            found = shingles(text or b"", hashes)
            sizes.append(len(found))
            prints.append(xxhash.xxh3_128_digest(found.tobytes()))
            bands.append(band_hashes(found))
        both = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.columns[0],
                pa.array(sizes, pa.int64()),
                pa.array(both[:, 0]),
                pa.array(both[:, 1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *bands]))),
            ],
            names=["_d", "n", "f1", "f2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        once = dict.fromkeys(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = [(d, shingles(t or b"", hashes).view(np.int64)) for d, t in once]
        ids, found = [d for d, x in made if len(x)], [x for _, x in made if len(x)]
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        values = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["node", "set"]
        )


def _direct(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (hub, node) of stars with 100 * intersection >= percent * union on full sets.

    No distinct here: it would bind the join to one partition for each hub, and a hub
    may have any number of members.  A pair that comes twice does no harm.
    """
    held = keep(stars.join(sets, "node").select("hub", "node", F.col("set").alias("a")), "near-held")
    both = held.join(sets.select(F.col("node").alias("hub"), F.col("set").alias("b")), "hub")
    shared = both.select("hub", "node", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("s"))
    return keep(shared.where(f"100L * i >= {percent}L * (s - i)").select("hub", "node"), "near-direct")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices."""
    sizes = np.array([len(x) for x in [*left, *right]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, place, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    often = n[place] > 1  # what one set alone holds is in no intersection
    owner, place = owner[often], place[often]
    column = np.cumsum(n > 1) - 1
    place = column[place]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, int((n > 1).sum()), _COLUMNS):
        at = slice(*np.searchsorted(place, (start, start + _COLUMNS)))
        held = np.zeros((len(sizes), _COLUMNS), np.float32)
        held[owner[at], place[at] - start] = 1
        total += held[: len(left)] @ held[len(left) :].T
    return total.astype(np.int64)


def _meet(percent: int):
    def run(block: pa.Table) -> pa.Table:
        """Links between components, each pair of components once, from the outside rows of a block to all its rows."""
        block = block.combine_chunks()
        outside = block["outside"].to_numpy()
        component = block["component"].to_numpy()
        sets = [x.values.to_numpy() for x in block["set"]]
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        links: set[tuple[int, int]] = set()
        if len(left) and len(right):
            sizes = np.array([len(x) for x in sets])
            both = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            near = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None] - both)
            near &= component[left][:, None] != component[right][None]
            links = {tuple(sorted(x)) for x in zip(*(component[side[at]].tolist() for side, at in zip((left, right), np.nonzero(near), strict=True)), strict=True)}
        u, v = zip(*_forest(links), strict=True) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _forest(links: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links enough to connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    kept = []
    for u, v in sorted(links):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((u, v))
    return kept


def _outside(stars: DataFrame, sets: DataFrame, direct: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between components that a star's members form and its hub's links don't show.

    Members outside their hub's component meet all members of the star, block by
    block, on full sets.  Only sets of the same or the next size class meet: others
    differ too much in size to be linked.  Blocks are bounded in rows and in shingles.
    """
    own = keep(components(direct.select(F.col("hub").alias("u"), F.col("node").alias("v"))), "near-own")
    named = stars.join(own, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    of_hub = own.select(F.col("node").alias("hub"), F.col("component").alias("c"))
    placed = keep(
        named.join(of_hub, "hub", "left")
        .withColumn("c", F.coalesce("c", "hub"))
        .select("hub", "node", "component", "c", (F.col("component") != F.col("c")).alias("outside")),
        "near-placed",
    )
    open_ = keep(placed.where("outside").groupBy("hub").agg(F.first("c").alias("c")), "near-open")
    if open_.isEmpty():
        return stars.sparkSession.createDataFrame([], "u long, v long")
    inside = placed.drop("c").join(open_.select("hub"), "hub", "left_semi")
    hubs = open_.select("hub", F.col("hub").alias("node"), F.col("c").alias("component"), F.lit(False).alias("outside"))
    width = 1.001 * math.log(100 / percent)
    rows = keep(
        inside.unionByName(hubs)
        .join(sets, "node")
        .select("hub", "component", "outside", "set", F.xxhash64("node").alias("h"), F.floor(F.log(F.size("set")) / width).cast("int").alias("size_class")),
        "near-open-rows",
    )
    per = F.greatest(F.lit(1.0), F.least(F.lit(float(_BLOCK_ROWS)), _BLOCK_SHINGLES / F.exp((F.col("size_class") + 1) * width)))
    plan = (
        rows.groupBy("hub", "size_class")
        .agg(F.count_if("outside").alias("n_out"), F.count(F.lit(1)).alias("n"))
        .select("hub", "size_class", F.ceil(F.col("n_out") / F.ceil(per / 4)).cast("int").alias("left"), F.ceil(F.col("n") / per).cast("int").alias("right"))
        .groupBy("hub")  # a row for each size class, of which there are few
        .agg(F.map_from_entries(F.collect_list(F.struct("size_class", F.struct("left", "right")))).alias("blocks"))
    )
    met = rows.join(keep(plan, "near-plan"), "hub")

    def dealt(mine: str, theirs: str) -> str:
        """The block pairs that a row takes part in, with its own block on one side."""
        own_block = f"size_class as {mine}_class, int(pmod(h, blocks[size_class].{mine})) as {mine}"
        pair = f"struct({own_block}, k as {theirs}_class, at as {theirs})"
        each = f"transform(sequence(0, coalesce(blocks[k].{theirs}, 0)), at -> {pair})"  # one too many, so never backwards
        classes = "array(size_class - 1, size_class, size_class + 1)"
        return f"flatten(transform({classes}, k -> slice({each}, 1, coalesce(blocks[k].{theirs}, 0))))"

    sides = [
        met.where(which).select("hub", "component", F.lit(out).alias("outside"), "set", F.explode(F.expr(dealt(mine, theirs))).alias("b"))
        for which, out, mine, theirs in (("outside", True, "left", "right"), ("true", False, "right", "left"))
    ]
    pairs = ["left_class", "left", "right_class", "right"]
    blocks = sides[0].select("hub", *[f"b.{c}" for c in pairs], "component", "outside", "set").unionByName(
        sides[1].select("hub", *[f"b.{c}" for c in pairs], "component", "outside", "set")
    )
    blocks = blocks.repartition("hub", *pairs)  # else a hub's blocks all stay where the join has put its rows
    return keep(blocks.groupBy("hub", *pairs).applyInArrow(_meet(percent), "u long, v long").distinct(), "near-between")


def links(classes: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) that connect all class representatives that share a bucket and are similar."""
    each = classes.select("rep", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = keep(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    members = keep(each.join(shared, "bucket"), "near-members")
    weight = keep(members.groupBy("rep").agg(F.sum("size").alias("w")), "near-weights")
    hubs = keep(
        members.join(weight, "rep")
        .groupBy("bucket")
        .agg(F.max(F.struct("w", F.bitwise_not("rep").alias("r"))).alias("h"))
        .select("bucket", F.bitwise_not("h.r").alias("hub")),
        "near-hubs",
    )
    stars = keep(members.join(hubs, "bucket").where("rep <> hub").select("hub", F.col("rep").alias("node")).distinct(), "near-stars")
    nodes = keep(stars.select("node").unionByName(stars.select(F.col("hub").alias("node"))).distinct(), "near-nodes")
    sets = keep(
        keyed.join(nodes, keyed["_d"] == nodes["node"], "left_semi").mapInArrow(_sets, "node long, set array<long>"), "near-sets"
    )
    direct = _direct(stars, sets, percent)
    return direct.select(F.col("hub").alias("u"), F.col("node").alias("v")).unionByName(_outside(stars, sets, direct, percent))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs."""
    keyed = docs.select(id_key(F.col(doc_id)).alias("_d"), F.col(text).cast("binary").alias("_t"))
    with passing(docs.sparkSession):
        signed = keep(keyed.mapInArrow(_signatures, "_d long, n long, f1 long, f2 long, bands array<long>"), "near-signatures", stays=True)
        classes = keep(
            signed.where("n > 0").groupBy("f1", "f2").agg(F.min("_d").alias("rep"), F.first("bands").alias("bands")), "near-classes"
        )
        found = links(classes, keyed, percent)
        # an id with several texts links their classes
        repeated = signed.groupBy("_d").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_d")
        several = (
            signed.where("n > 0").join(repeated, "_d").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select(F.col("_d").alias("u"), F.col("rep").alias("v"))
        )
        labels = components(found.unionByName(several))
        named = keep(
            classes.select("f1", "f2", "rep")
            .join(labels, classes["rep"] == labels["node"], "left")
            .select("f1", "f2", F.coalesce("component", "rep").alias("component")),
            "near-named",
            stays=True,
        )
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_d"))
    back = lambda c: F.when(c != NULL_ID, c)
    return (
        signed.select("_d", "n", "f1", "f2")
        .join(named, ["f1", "f2"], "left")
        .select(
            back(F.col("_d")).alias("doc_id"), F.col("n").alias("n_shingles"), back(own).alias("component_id"), (F.col("_d") == own).alias("kept")
        )
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 85) -> DataFrame:
    """docs without the documents that a smaller id of their group stands for."""
    with passing(docs.sparkSession):
        groups = near_groups(docs, text, doc_id, percent).where("not kept")
        gone = keep(groups.select(id_key(F.col("doc_id")).alias("_gone")).distinct(), "near-gone", stays=True)
    return docs.join(gone, id_key(docs[doc_id]) == gone["_gone"], "left_anti")


#: The same groups in DuckDB, from all pairs of texts that share a shingle and without buckets.
ORACLE_SQL = r"""
with recursive word as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
shingle as (
    select distinct doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) as s
    from word where len(w) > 0),
sized as (select doc_id, count(*) as n from shingle group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as i from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (
    select u, v from shared join sized x on x.doc_id = u join sized y on y.doc_id = v where 100 * i >= 85 * (x.n + y.n - i)),
edge as (select u, v from link union all select v, u from link),
reach(node, least) as (
    select u, v from edge
    union
    select e.v, r.least from reach r join edge e on e.u = r.node where r.least < e.v)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id, coalesce(m, d.doc_id) >= d.doc_id as kept
from documents d left join sized using (doc_id) left join (select node, min(least) as m from reach group by node) r on r.node = d.doc_id
"""
