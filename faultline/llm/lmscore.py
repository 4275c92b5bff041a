"""LM scoring by cross-entropy difference.

Two bigram models share one vocabulary of V words: the target model learns from the
labelled good documents, the background model from all documents.  A document's
score is its cross-entropy per token under the target model less that under the
background model, in bits; lower means closer to the target.

Both models are smoothed alike, by MU tokens spread evenly over the vocabulary:

    p(b | a) = (c(ab) + MU / V) / (c(a) + MU)

A document's own tokens are left out of all counts that it is scored with, so that
a text is judged by what other documents say, and one that occurs twice stands out.
So a score is a sum over the document's different bigrams and words of terms that
each depend on one count, and what only the document itself holds adds nothing.

Counts cover the whole corpus, and every word and every bigram keeps its own.
Words and bigrams are entries of one table: a key, its count in all documents and
its count in the target's.  The ``max_broadcast`` most frequent entries are
broadcast and added where texts are read; for its other keys a document asks the
table by a join.  A bit map of ``FILTER_BITS`` bits tells most keys that are not in
the table, so that they need not be asked for; it is left out where the table is too
large for it.  Both bounds decide what travels and have no part in a score; what
is joined is rare by definition, so no key is hot.

Keys are 64-bit hashes; two bigrams that shared one would share their counts
(expected once in about 70 corpora of 700 million different bigrams).

Cases: null and empty texts have no tokens and score 0 over 0 tokens.  Labels
that are null, of unknown ids or on held-out rows teach nothing; without any
target document every score is 0.  Repeated rows count as often as they occur,
and are scored alike.  An empty table gives an empty table.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm._common import keep
from faultline.llm.toxicity import held_out

MU = 100.0
#: The hash of the end of a document, which no word has by intent.
END = np.uint64(1)
_FLUSH = 1 << 19
#: So many texts, of so many bytes in all, are taken apart at a time.
_ROWS, _BYTES = 512, 4 << 20
#: Bits of the map of keys, by the upper bits of a key, and the part of it that one task makes.
FILTER_BITS, _SLICE_BITS = 28, 22


def tables() -> tuple[np.ndarray, np.ndarray]:
    return words.classes(r"\w", r"[^\w\s]")


def word_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of words are even."""
    return (tokens & ~np.uint64(1)).astype(np.int64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of bigrams are odd."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    return (words.mix(x) | np.uint64(1)).astype(np.int64)


def bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, first word, second word) of all bigrams of a batch, with the end before and after each text."""
    row, token = words.cut(texts, tables())
    n = np.bincount(row, minlength=len(texts))
    some = np.flatnonzero(n)
    size = n[some] + 2
    stream = np.full(int(size.sum()), END)
    inside = np.ones(len(stream), bool)
    last = np.cumsum(size) - 1
    inside[last] = inside[last - size + 1] = False
    stream[inside] = token
    owner = np.repeat(some, size)
    pairs = np.ones(max(len(stream) - 1, 0), bool)
    pairs[last[:-1]] = False
    at = np.flatnonzero(pairs)
    return owner[at], stream[at], stream[at + 1]


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, with the sums of its counts."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return ordered[starts], *(np.add.reduceat(c[order], starts) if len(keys) else c for c in counts)


def portioned(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded text, so that memory follows the part."""
    for batch in batches:
        for first, end in words.portions(pc.binary_length(batch.columns[text]).to_pylist(), _ROWS, _BYTES):
            yield batch.slice(first, end - first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, m): words and bigrams counted in all documents and in the target's, by about ``_FLUSH`` keys at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        found = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["key", "n", "m"])

    for batch in portioned(batches, 1):
        target, texts = batch.columns
        row, a, b = bigrams(texts.to_pylist())
        good = np.array(target.to_pylist(), bool)[row].astype(np.int64)
        # a word is counted where it is second; the end is where the text's last word is first
        keys = np.concatenate([word_keys(b), pair_keys(a, b)])
        held.append(summed(keys, np.ones(len(keys), np.int64), np.concatenate([good, good])))
        if sum(len(h[0]) for h in held) >= _FLUSH:
            yield out()
    if held:
        yield out()


def entries(marked: DataFrame) -> DataFrame:
    """(key, n, m) of every word, and of every bigram that occurs more than once: others add nothing to a score."""
    counted = marked.select("good", "text").mapInArrow(_count, "key long, n long, m long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 1 or key % 2 = 0")


def most_frequent(counted: DataFrame, most: int) -> Column:
    """The condition that holds for the rows of the largest counts n, ``most`` of them at most.

    A histogram of sixteen bins per doubling gives the least bin that fits, so rows
    of about equal counts go together and no task sees more than its share.
    """
    level = F.floor(F.log2(F.col("n")) * 16)
    left = most
    least = 1 << 20
    for bin_, rows in sorted(counted.groupBy(level.alias("b")).count().collect(), reverse=True):
        left -= rows
        if left < 0:
            break
        least = bin_
    return level >= least


def among(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key lies in an ordered array, and whether it is there."""
    at = np.minimum(np.searchsorted(ordered, wanted), max(len(ordered) - 1, 0))
    return at, ordered[at] == wanted if len(ordered) else np.zeros(len(wanted), bool)


def key_map(rare: DataFrame) -> np.ndarray:
    """FILTER_BITS to the power of two bits, with those set that a key of the table has."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.columns[0].to_numpy().astype(np.uint64) >> np.uint64(64 - FILTER_BITS)
            part = place >> np.uint64(_SLICE_BITS)
            for which in np.unique(part).tolist():
                flags = slices.setdefault(which, np.zeros(1 << _SLICE_BITS, bool))
                flags[place[part == which] & np.uint64((1 << _SLICE_BITS) - 1)] = True
        for which, flags in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["slice", "bits"])

    n = 1 << (FILTER_BITS - _SLICE_BITS)
    cut = F.shiftrightunsigned("key", 64 - FILTER_BITS + _SLICE_BITS)
    made = rare.select("key").repartition(n, cut).mapInArrow(mark, "slice long, bits binary").toArrow()
    out = np.zeros((n, (1 << _SLICE_BITS) // 8), np.uint8)
    for which, bits in zip(made["slice"].to_pylist(), made["bits"].to_pylist(), strict=True):
        out[which] |= np.frombuffer(bits, np.uint8)
    return out.ravel()


def possible(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Whether the table may hold each key."""
    if bits is None:
        return np.ones(len(keys), bool)
    place = keys.astype(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0


Known = tuple[np.ndarray, np.ndarray, np.ndarray]


def term(key: Column, n: Column, m: Column, own: Column, good: Column, delta: float) -> Column:
    """What the occurrences of one key in a document add to its sum."""
    word = key % 2 == 0
    prior = F.when(word, F.lit(MU)).otherwise(F.lit(delta))
    rest = F.log2(F.greatest(n - own, F.lit(0)) + prior) - F.log2(F.greatest(m - own * good, F.lit(0)) + prior)
    return F.when(word, -rest).otherwise(rest) * own


def weighed(
    texts: list[str | None], good: np.ndarray, known: Known, bits: np.ndarray | None, delta: float
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bigrams, sum of the terms of known keys) of each text, and (place, key, own count) of what it has to ask for."""
    row, a, b = bigrams(texts)
    # first words are the second words of the bigrams before, and the end is both
    keys, both = np.concatenate([word_keys(b), pair_keys(a, b)]), np.concatenate([row, row])
    each, place = np.unique(keys, return_inverse=True)
    code, own = np.unique(both * len(each) + place, return_counts=True)
    text, which = np.divmod(code, max(len(each), 1))
    at, there = among(known[0], each)
    wanted = ~there & possible(bits, each)
    mine = there[which]
    ask = wanted[which]
    at, times, of = at[which[mine]], own[mine], text[mine]
    word = each[which[mine]] % 2 == 0
    prior = np.where(word, MU, delta)
    rest = np.log2(np.maximum(known[1][at] - times, 0) + prior) - np.log2(np.maximum(known[2][at] - times * good[of], 0) + prior)
    total = np.bincount(of, weights=np.where(word, -rest, rest) * times, minlength=len(texts))
    return np.bincount(row, minlength=len(texts)), total, (text[ask], each[which[ask]], own[ask])


def score(
    docs: DataFrame,
    labels: DataFrame,
    max_broadcast: int = 1_000_000,
    target: str = "quality = 1",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, score), one row per document."""
    context = docs.sparkSession.sparkContext
    good = labels.where(f"doc_id is not null and {target}").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_good")).distinct()
    good = keep(good, "lm-target")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = own.join(good, own["doc_id"] == good["_good"], "left").select("doc_id", F.col("_good").isNotNull().alias("good"), "text")

    table = keep(entries(named), "lm-counts")
    taught, size = table.where("key % 2 = 0").agg(F.sum("m"), F.count(F.lit(1))).first()
    delta = MU / (size + 1)
    table = table.where("n > 1")
    frequent = most_frequent(table, max_broadcast)
    near = table.where(frequent).toArrow()
    order = np.argsort(near["key"].to_numpy())
    shared = context.broadcast(tuple(near[c].to_numpy()[order] for c in ("key", "n", "m")))
    rare = table.where(~frequent)
    bits = context.broadcast(key_map(rare) if rare.count() <= 1 << FILTER_BITS else None)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document its head with the sum of what is known, and a row for each key that it asks for."""
        for batch in portioned(batches, 4):
            rows, ids, held, target, texts = batch.columns
            right = np.array(target.to_pylist(), np.int64)
            steps, total, (text, key, own) = weighed(texts.to_pylist(), right, shared.value, bits.value, delta)
            number, blank, heads = rows.to_numpy(), len(key), len(ids)
            columns = [
                pa.array(np.r_[number, number[text]]),
                pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(blank, pa.int64())]),
                pa.concat_arrays([held.cast(pa.bool_()), pa.nulls(blank, pa.bool_())]),
                pa.concat_arrays([pa.array(steps.astype(np.int64)), pa.nulls(blank, pa.int64())]),
                pa.concat_arrays([pa.array(total.astype(float)), pa.nulls(blank, pa.float64())]),
                pa.concat_arrays([pa.nulls(heads, pa.int64()), pa.array(key)]),
                pa.concat_arrays([pa.nulls(heads, pa.int64()), pa.array(own.astype(np.int64))]),
                pa.concat_arrays([pa.nulls(heads, pa.int64()), pa.array(right[text])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "steps", "gained", "key", "own", "good"])

    given = named.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("h"), "good", "text")
    kinds = "row long, doc_id long, held_out boolean, steps long, gained double, key long, own long, good long"
    parts = keep(given.mapInArrow(weigh, kinds), "lm-parts")
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("held_out", "boolean"), ("steps", "long"))]
    asked = parts.where("key is not null").select("row", "key", "own", "good").join(rare, "key")
    far = asked.select("row", *nothing, term(*[F.col(c) for c in ("key", "n", "m", "own", "good")], delta).alias("gained"))
    every = parts.where("key is null").select("row", "doc_id", "held_out", "steps", "gained").unionByName(far)
    mean = F.sum("gained") / F.greatest(F.max("steps"), F.lit(1))
    return every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.greatest(F.max("steps") - 1, F.lit(0)).alias("n_tokens"),
        (mean if taught else F.lit(0.0)).alias("score"),
    ).drop("row")
