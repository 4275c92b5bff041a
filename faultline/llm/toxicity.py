"""Toxicity by nearest labelled examples.

A text's terms are all its lower-cased words.  The model is fitted on a bounded
sample of labelled rows (``max_per_label`` of each label):

* every word of a sampled row is a term of the index;
* weight: (1 + ln n) x IDF x label weight.  IDF is from the document frequencies of
  these terms over all documents, a word that no example holds has that of a new
  one.  The label weight is 1 + G^0.75 / 2, where G is the likelihood ratio statistic
  of the term and the labels in the sample; it is 1 for a word no example holds;
* index: unit vectors over the whole texts, inverted.  Examples are ordered by label
  and strongest term and cut into blocks.  A term has its postings, block by block,
  and its largest weight in each of these blocks; words of very many examples have
  dense rows instead.

A text, normed over all its words, is scored against its ``k`` nearest examples by
exact cosine: the sums of its terms' block maxima bound what a block can hold, the
best two blocks are scored first, and then all blocks whose bound reaches the k-th
cosine so far.  Examples vote with their cosine times the number of labelled rows
they stand for, against a prior: the rate of label 1, which is also the score of a
text that shares no word with any example.  The k-th place is shared by the examples
that tie.  Words go by 64-bit hashes.

Cases: null and empty texts have no terms and get the prior.  Labels that are
null, of null or unknown ids, or on held-out rows teach nothing.  Without any
usable label, every score is 0.  A document labelled twice counts each label.
Repeated rows are scored alike.  An empty table gives an empty table.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm._common import id_key, keep, tune

_BLOCK, _FIRST = 64, 2
_PRIOR_WEIGHT = 0.1
#: Words in one of so many examples or more are dense rows of the index, up to the first number of them.
_DENSE, _COMMON = 512, 64
#: Cosines of so many texts, of so many bytes in all, are held at a time.
_TEXTS, _BYTES = 256, 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def batch_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, hash and count of every word of every text, by text."""
    row, token = words.cut(texts, words.classes(r"[^\W\d_]"))
    each, place = np.unique(token.view(np.int64), return_inverse=True)
    both, counts = np.unique(row * len(each) + place, return_counts=True)
    row, place = np.divmod(both, max(len(each), 1))
    return row, each[place], counts


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers from each first on, n of them, and the place of the range that each is from."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner], owner


@dataclass
class Index:
    """All words of all examples: dense rows of the common ones, postings by blocks of the others.

    start and blocks lead from a term to its parts; a part is what one block holds of
    it: the block, the largest weight, and where its postings begin and how many there are.
    """

    terms: np.ndarray
    weight: np.ndarray
    unseen: float
    row: np.ndarray
    dense: np.ndarray
    highest: np.ndarray
    start: np.ndarray
    blocks: np.ndarray
    block: np.ndarray
    maximum: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    example: np.ndarray
    posted: np.ndarray
    label: np.ndarray
    vote: np.ndarray
    ids: np.ndarray
    prior: float
    k: int

    def cosines(self, rows: int, row: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
        """Cosines of each text of a batch with the examples of the blocks that may hold its nearest, 0 for all
        others, and how many blocks were scored."""
        examples, n_blocks = len(self.ids), self.highest.shape[1]
        at, known = places(self.terms, terms)
        query = (1 + np.log(counts)) * np.where(known, self.weight[at] if len(self.terms) else 0.0, self.unseen)
        norm = np.sqrt(np.bincount(row, weights=query**2, minlength=rows))
        query /= norm[row]
        row, at, query = row[known], at[known], query[known]
        common = self.row[at] >= 0
        wide = np.zeros((rows, len(self.dense)))
        wide[row[common], self.row[at[common]]] = query[common]
        row, at, query = row[~common], at[~common], query[~common]
        part, of = spread(self.start[at], self.blocks[at])
        cell = row[of] * n_blocks + self.block[part]
        bound = wide @ self.highest
        bound += np.bincount(cell, weights=query[of] * self.maximum[part], minlength=rows * n_blocks).reshape(rows, n_blocks)
        found = np.zeros((rows, examples))
        done = np.zeros((rows, n_blocks), bool)
        first = np.argsort(-bound, axis=1)[:, :_FIRST]
        open_ = np.zeros((rows, n_blocks), bool)
        np.put_along_axis(open_, first, True, axis=1)
        open_ &= bound > 0
        for _ in range(2):
            for b in np.flatnonzero(open_.any(axis=0)):
                texts = np.flatnonzero(open_[:, b])
                found[texts, b * _BLOCK : (b + 1) * _BLOCK] = wide[texts] @ self.dense[:, b * _BLOCK : (b + 1) * _BLOCK]
            mine = open_.ravel()[cell]
            posting, which = spread(self.begin[part[mine]], self.length[part[mine]])
            entry = of[mine][which]
            place = row[entry] * examples + self.example[posting]
            found += np.bincount(place, weights=query[entry] * self.posted[posting], minlength=rows * examples).reshape(rows, examples)
            done |= open_
            kth = np.partition(found, -self.k, axis=1)[:, -self.k] if examples > self.k else np.zeros(rows)
            open_ = (bound >= kth[:, None] - 1e-8) & (bound > 0) & ~done
        return np.round(found, 9), int(done.sum())

    def judge(self, cosines: np.ndarray) -> tuple[float, list[dict]]:
        """The score of a text from its cosines, and its three nearest examples."""
        kth = np.partition(cosines, -self.k)[-self.k] if len(cosines) > self.k else 0.0
        near = np.flatnonzero((cosines >= kth) & (cosines > 0))
        if not len(near):
            return self.prior, []
        near = near[np.lexsort((near, -cosines[near]))]
        votes = cosines[near] * self.vote[near]
        weight = _PRIOR_WEIGHT * self.vote.min()
        score = (float((votes * self.label[near]).sum()) + weight * self.prior) / (votes.sum() + weight)
        seen = [{"doc_id": int(self.ids[e]), "cosine": float(cosines[e]), "toxic": int(self.label[e])} for e in near[:3]]
        return min(max(score, 0.0), 1.0), seen


def places(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value lies in an ordered array, and whether it is there."""
    at = np.minimum(np.searchsorted(ordered, wanted), max(len(ordered) - 1, 0))
    return at, ordered[at] == wanted if len(ordered) else np.zeros(len(wanted), bool)


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, labels, texts = batch.columns
        row, terms, counts = batch_terms(texts.to_pylist())
        ends = pa.array(np.searchsorted(row, np.arange(len(docs) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [docs, labels, pa.ListArray.from_arrays(ends, pa.array(terms)), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))],
            names=["doc_id", "label", "terms", "counts"],
        )


def sample(docs: DataFrame, labels: DataFrame, max_per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """Terms of the sampled labelled rows, and how many rows each label has to teach from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")
    )
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    order = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]
    drawn = [usable.where(F.col("label") == y).orderBy(*order).limit(max_per_label) for y in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * max_per_label rows at most
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(chosen, "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(_sampled_terms, "doc_id long, label int, terms array<long>, counts array<int>")
    )
    return keep(rows, "label-terms"), totals


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, n = shared.value, 0
        found = np.zeros(len(ordered), np.int64)
        for batch in batches:
            n += batch.num_rows
            at, known = places(ordered, batch_terms(batch.columns[0].to_pylist())[1])
            found += np.bincount(at[known], minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, found[at]])], names=["term", "n"])

    got = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    place, n = got["term"].to_numpy(), got["n"].to_numpy()
    frequency = np.zeros(len(terms))
    frequency[place[place >= 0]] = n[place >= 0]
    return frequency, int(n[place < 0].sum())


def label_weight(n0: np.ndarray, n1: np.ndarray, all0: float, all1: float) -> np.ndarray:
    """1 + G^0.75 / 2 for terms of n0 and n1 examples of the labels 0 and 1; nothing is cut off."""

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return sum(np.where(x > 0, x * np.log(x / (a + b)), 0.0) for x in (a, b))

    whole = part(np.array(float(all0)), np.array(float(all1)))
    g = 2 * np.maximum(part(n0, n1) + part(all0 - n0, all1 - n1) - whole, 0.0)
    return 1 + g**0.75 / 2


def fit(docs: DataFrame, rows: DataFrame, totals: dict[int, int], k: int) -> Index:
    drawn = rows.orderBy("doc_id", "label").toArrow().combine_chunks()
    lists = drawn["terms"].combine_chunks()
    terms, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    frequency, n_docs = frequencies(docs, terms)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    counts = drawn["counts"].combine_chunks().flatten().to_numpy().astype(float)
    return build(terms, place, counts, sizes, drawn["label"].to_numpy().astype(int), drawn["doc_id"].to_numpy(), frequency, n_docs, totals, k)


def build(
    terms: np.ndarray, place: np.ndarray, counts: np.ndarray, sizes: np.ndarray, label: np.ndarray, ids: np.ndarray,
    frequency: np.ndarray, n_docs: int, totals: dict[int, int], k: int,
) -> Index:
    """place and counts: the terms of the examples, ``sizes`` of them each."""
    example = np.repeat(np.arange(len(ids)), sizes)
    n1 = np.bincount(place, weights=label[example].astype(float), minlength=len(terms))
    n = np.bincount(place, minlength=len(terms))
    idf = lambda f: np.log((1 + n_docs) / (1 + f)) + 1
    weight = idf(frequency) * label_weight(n - n1, n1, float((label == 0).sum()), float((label == 1).sum()))
    value = (1 + np.log(counts)) * weight[place]
    value /= np.sqrt(np.bincount(example, weights=value**2, minlength=len(ids)))[example]
    # neighbours share a label and the term that says most
    strongest = np.full(len(ids), -1, np.int64)
    by_value = np.lexsort((value, example))
    strongest[example[by_value]] = place[by_value]  # the last of each example stays
    order = np.lexsort((ids, strongest, label))
    new_place = np.empty(len(ids), np.int64)
    new_place[order] = np.arange(len(ids))
    example, label, ids = new_place[example], label[order], ids[order]

    n_blocks = -(-len(ids) // _BLOCK)
    chosen = np.argsort(-n, kind="stable")[:_DENSE]
    chosen = chosen[n[chosen] >= _COMMON]
    dense_row = np.full(len(terms), -1, np.int64)
    dense_row[chosen] = np.arange(len(chosen))
    dense = np.zeros((len(chosen), n_blocks * _BLOCK))
    common = dense_row[place] >= 0
    dense[dense_row[place[common]], example[common]] = value[common]
    highest = dense.reshape(len(chosen), n_blocks, _BLOCK).max(axis=2) if len(chosen) else np.zeros((0, n_blocks))

    by_term = np.lexsort((example[~common], place[~common]))
    term, posted_example, posted = place[~common][by_term], example[~common][by_term], value[~common][by_term]
    part = term * max(n_blocks, 1) + posted_example // _BLOCK
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    part_term, block = np.divmod(part[begin], max(n_blocks, 1))
    blocks = np.bincount(part_term, minlength=len(terms))
    vote = np.array([totals.get(y, 0) / max((label == y).sum(), 1) for y in (0, 1)])[label] if len(label) else np.zeros(0)
    prior = float((vote * label).sum() / vote.sum()) if len(label) else 0.0
    return Index(
        terms, weight, float(idf(0)), dense_row, dense[:, : len(ids)], highest, np.cumsum(blocks) - blocks, blocks, block,
        np.maximum.reduceat(posted, begin) if len(begin) else posted, begin, np.diff(np.append(begin, len(part))),
        posted_example.astype(np.int32), posted, label, vote, ids, prior, k,
    )


_EVIDENCE = "array<struct<doc_id:long,cosine:double,toxic:int>>"


def score(
    docs: DataFrame,
    labels: DataFrame,
    k: int = 15,
    threshold: float = 0.7,
    max_per_label: int = 2000,
    **columns: str,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per document.

    evidence: the three nearest labelled examples with their cosines and labels.
    """
    spark = tune(docs.sparkSession)
    named = docs.select(F.col(columns.get("doc_id", "doc_id")).alias("doc_id"), F.col(columns.get("text", "text")).alias("text"))
    rows, totals = sample(named, labels, max_per_label)
    shared = spark.sparkContext.broadcast(fit(named, rows, totals, k))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for first, end in words.portions(pc.binary_length(whole.columns[2]).to_pylist(), _TEXTS, _BYTES):
                ids, held, texts = whole.slice(first, end - first).columns
                cosines, _ = index.cosines(len(ids), *batch_terms(texts.to_pylist()))
                judged = [index.judge(c) for c in cosines]
                scores = [s for s, _ in judged]
                evidence = pa.array([e for _, e in judged], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))
                predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(scores, pa.float64()), predicted, evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"]
                )

    given = named.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("h"), "text")
    return given.mapInArrow(judge, f"doc_id long, held_out boolean, score double, predicted int, evidence {_EVIDENCE}")


def drop_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs without the rows that score() rejects; a rejected id goes with all its rows."""
    bad = keep(score(docs, labels, **settings).where("predicted = 1").select(id_key(F.col("doc_id")).alias("_bad")).distinct(), "toxic")
    return docs.join(bad, id_key(docs["doc_id"]) == bad["_bad"], "left_anti")
