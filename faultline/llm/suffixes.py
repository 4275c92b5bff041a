"""Suffix-array dedup of long repeated strings by prefix-free parsing.

A byte is removed if a ``LENGTH``-byte string that starts in some document and
covers it also starts anywhere else in the corpus.

Only the order of suffixes up to ``LENGTH`` bytes matters, and of that order only
which neighbours are equal, so the corpus order is kept as equality classes:

* Parse.  The trigger of a start is the place of the least rolling hash in the
  ``LOOK`` places from it.  Starts with one trigger form a phrase; phrases are
  bounded, and since the trigger depends on nothing outside the string, equal
  strings have the same trigger at the same distance.
* Dictionary.  A phrase is known by its core (the bytes that each of its strings
  shares, from the trigger on) and by its full context (the bytes of all its
  strings), both as rolling fingerprints.  Phrases of a core that occurs once
  hold no repeat.
* Classes.  Phrases of equal full context are equal in all their strings, which
  are repeats.  One phrase of each class meets the other classes of its core on
  the next level: cut into runs of 8 starts about the trigger, then into starts.

So highly repetitive text collapses into classes early, and only the phrases on
the borders of repeats are looked at start by start.  A full context is known by
128 bits of BLAKE2b over its bytes and its place about the trigger, so that equal
digests are equal bytes for all that is known of that hash; cores, which only
select candidates, by 64 bits of a rolling sum.

Cases: a null text is empty.  Texts below ``LENGTH`` bytes lose nothing.  Equal
rows repeat each other.  Rows that share an id are told apart by their text.
Very long texts and runs of one byte take linear time.  An empty table gives an
empty table.  Input columns pass through unless they clash with an output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm._common import NULL_ID, keep, passing, row_key

LENGTH, LOOK, RUN = 200, 128, 8
_GRAM = 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of base, modulo 2**64, at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1 << 16, 1 << n.bit_length()), np.uint64(base))
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


class Rolling:
    """Sums of any stretch of a text over hashes of its 8-byte grams."""

    def __init__(self, text: bytes):
        self.text = text
        grams = np.ndarray((len(text) - _GRAM + 1,), "<u8", text, strides=(1,))
        self.grams = grams * _MIX[0]
        self.grams ^= self.grams >> np.uint64(32)
        self.grams *= _MIX[1]
        self.grams ^= self.grams >> np.uint64(29)
        self._sums: np.ndarray | None = None

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums of text[start:end], at least 8 bytes each."""
        n = len(self.grams)
        if self._sums is None:
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.grams * powers(n)[:n])))
        value = (self._sums[end - _GRAM + 1] - self._sums[start]) * powers(n, _INVERSE)[start]
        value ^= value >> np.uint64(31)
        return value * _MIX[1]

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of BLAKE2b of text[start:end]."""
        view = memoryview(self.text)
        made = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        both = np.frombuffer(made, "<u8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def triggers(rolling: Rolling, n: int) -> np.ndarray:
    """The trigger of each start 0..n-LENGTH: the leftmost least hash of LOOK places."""
    low = (rolling.grams & _HIGH) | np.arange(len(rolling.grams), dtype=np.uint64)
    step = 1
    while step < LOOK:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return (low[: n - LENGTH + 1] & _LOW).astype(np.int64)


def phrases(text: bytes) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray] | None:
    """Trigger, first start and last start of each phrase."""
    if len(text) < LENGTH:
        return None
    rolling = Rolling(text)
    at = triggers(rolling, len(text))
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    last = np.append(first[1:] - 1, len(at) - 1)
    return rolling, at[first], first, last


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each integer of the given ranges, and the range it is from."""
    n = last - first + 1
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owner], owner


Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def whole_phrases(rolling: Rolling, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Units:
    """(core, full 1, full 2, first, last) of phrases; a core is LENGTH - LOOK + 1 bytes from the trigger."""
    core = rolling.of(at, at + LENGTH - LOOK + 1)
    one, two = rolling.digests(first, last + LENGTH)
    shift = mixed(at - first)
    return core, one + shift, two + shift, first, last


def mixed(x: np.ndarray) -> np.ndarray:
    y = (x.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    return (y ^ (y >> np.uint64(32))) * _MIX[1]


def runs(rolling: Rolling, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Units:
    """Phrases cut into runs of starts that lie RUN * j to RUN * j + RUN - 1 before the trigger."""
    far, near = (at - first) // RUN, (at - last) // RUN
    j, owner = spread(near, far)
    begin = np.maximum(first[owner], at[owner] - RUN * j - RUN + 1)
    end = np.minimum(last[owner], at[owner] - RUN * j)
    core_from = at[owner] - RUN * j
    core = rolling.of(core_from, core_from - RUN + 1 + LENGTH) + mixed(j)
    one, two = rolling.digests(begin, end + LENGTH)
    shift = mixed(at[owner] - begin)
    return core, one + shift, two + shift, begin, end


def single_starts(rolling: Rolling, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Units:
    begin, _ = spread(first, last)
    one, two = rolling.digests(begin, begin + LENGTH)
    return one, one, two, begin, begin


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core) of every phrase."""
    for batch in batches:
        found = []
        for text in batch.columns[0].to_pylist():
            if parsed := phrases(text or b""):
                rolling, at, _, _ = parsed
                found.append(rolling.of(at, at + LENGTH - LOOK + 1))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["core"])


def _placed_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, _d, _h, first, last, at) of every phrase."""
    for batch in batches:
        d, h, texts = batch.columns
        rows, found = [], []
        for row, text in enumerate(texts.to_pylist()):
            if parsed := phrases(text or b""):
                rolling, at, first, last = parsed
                rows.append(np.full(len(at), row))
                found.append((rolling.of(at, at + LENGTH - LOOK + 1).view(np.int64), first, last, at))
        if found:
            row = pa.array(np.concatenate(rows))
            core, first, last, at = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(core), d.take(row), h.take(row), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(at.astype(np.int32))],
                names=["core", "_d", "_h", "first", "last", "at"],
            )


_UNITS = "core long, f1 long, f2 long, _d long, _h long, first int, last int, at int"


def _units(cut: Callable[..., Units]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _UNITS from rows (_d, _h, text, parts); parts are structs (first, last, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h, texts, parts = batch.columns
            offsets, fields = parts.offsets.to_numpy(), [f.to_numpy().astype(np.int64) for f in parts.values.flatten()]
            rows, found = [], []
            for row, text in enumerate(texts.to_pylist()):
                first, last, at = (f[offsets[row] : offsets[row + 1]] for f in fields)
                made = cut(Rolling(text), at, first, last)
                trigger = np.searchsorted(np.sort(last), made[3])  # the part that each unit is from
                order = np.argsort(last)
                rows.append(np.full(len(made[0]), row))
                found.append((*made, at[order][trigger]))
            if found:
                row = pa.array(np.concatenate(rows))
                core, f1, f2, first, last, at = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x.view(np.int64)) for x in (core, f1, f2)),
                        d.take(row),
                        h.take(row),
                        *(pa.array(x.astype(np.int32)) for x in (first, last, at)),
                    ],
                    names=["core", "f1", "f2", "_d", "_h", "first", "last", "at"],
                )

    return run


def _parts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_d", "_h").agg(F.collect_set(F.struct("first", "last", "at")).alias("parts"))


def _level(units: DataFrame, deepest: bool) -> tuple[DataFrame, DataFrame | None]:
    """(starts that are repeats: _d, _h, first, last; parts to look at on the next level)."""
    classes = keep(
        units.groupBy("core", "f1", "f2").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("_d", "_h", "first", "last", "at")).alias("one")
        ),
        "suffix-classes",
    )
    repeated = classes.where("n > 1").select("core", "f1", "f2")
    marks = keep(units.join(repeated, ["core", "f1", "f2"], "left_semi").select("_d", "_h", "first", "last"), "suffix-marks")
    if deepest:
        return marks, None
    mixed_cores = keep(classes.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core"), "suffix-cores")
    return marks, keep(_parts(classes.join(mixed_cores, "core", "left_semi").select("one.*")), "suffix-parts")


def repeated_starts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_d, _h, marks): for each row with repeats, the ranges of starts of repeated strings."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(*row_key(F.col(doc_id), F.col(text)), raw.alias("_t"))
    common = keep(
        docs.select(raw).mapInArrow(_cores, "core long").groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core"), "suffix-common"
    )
    placed = keyed.mapInArrow(_placed_cores, "core long, _d long, _h long, first int, last int, at int")
    parts = keep(_parts(placed.join(common, "core", "left_semi")), "suffix-parts")
    texts = keep(keyed.join(parts, ["_d", "_h"]).select("_d", "_h", "_t", "parts"), "suffix-texts")
    marks, parts = _level(keep(texts.mapInArrow(_units(whole_phrases), _UNITS), "suffix-units"), False)
    found = [marks]
    for cut, deepest in ((runs, False), (single_starts, True)):
        near = texts.drop("parts").join(parts, ["_d", "_h"]).select("_d", "_h", "_t", "parts")
        marks, parts = _level(keep(near.mapInArrow(_units(cut), _UNITS), "suffix-units"), deepest)
        found.append(marks)
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("_d", "_h").agg(F.collect_set(F.struct("first", "last")).alias("marks"))


def removed_runs(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in the given ranges."""
    spans: list[list[int]] = []
    for first, last in sorted(marks):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + LENGTH)
        else:
            spans.append([first, last + LENGTH])
    return [(a, b) for a, b in spans]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks = batch.columns[-2:]
        left, spans = [], []
        for text, ranges in zip(texts.to_pylist(), marks.to_pylist(), strict=True):
            gone = removed_runs([(r["first"], r["last"]) for r in ranges or ()])
            at, out = 0, []
            for a, b in gone:
                out.append(text[at:a])
                at = b
            out.append(text[at:])
            left.append(b"".join(out))
            spans.append([{"start": a, "end": b} for a, b in gone])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(left, pa.binary()), pa.array(spans, kind)],
            names=[*batch.schema.names[:-2], "kept", "spans"],
        )


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, kept, spans): each text's remaining bytes and the runs that went."""
    with passing(docs.sparkSession):
        marks = keep(repeated_starts(docs, text, doc_id), "suffix-spans", stays=True)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(*row_key(F.col(doc_id), F.col(text)), raw.alias("_t"))
    met = keyed.join(marks, ["_d", "_h"], "left")
    named: list[Column] = [F.when(F.col("_d") != NULL_ID, F.col("_d")).alias("doc_id"), F.octet_length("_t").cast("long").alias("n_bytes")]
    return met.select(*named, "_t", "marks").mapInArrow(
        _cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>"
    )


def repeat_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The same in DuckDB, from all 200-byte strings and without parsing.
ORACLE_SQL = """
with raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
placed as (select doc_id, s, md5(b[s:s + 199]) as h from (select doc_id, b, unnest(range(1, octet_length(b) - 198)) as s from raw)),
many as (select h from placed group by h having count(*) > 1),
hit as (select doc_id, s, s > 200 + lag(s, 1, -1000) over (partition by doc_id order by s) as opens from placed join many using (h)),
run as (
    select doc_id, min(s) as a, max(s) + 200 as z
    from (select doc_id, s, sum(cast(opens as integer)) over (partition by doc_id order by s) as r from hit) group by doc_id, r),
piece as (
    select doc_id, lag(z, 1, 1) over (partition by doc_id order by a) as p, a as q from run
    union all select doc_id, max(z), null from run group by doc_id),
kept as (
    select doc_id, string_agg(hex(b[p:coalesce(q - 1, octet_length(b))]), '' order by p) as x
    from piece join raw using (doc_id) where p < coalesce(q, octet_length(b) + 1) group by doc_id),
gone as (select doc_id, sum(z - a) as n, count(*) as k from run group by doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(k, 0) as n_spans,
    case when k is null then sha256(b) else sha256(unhex(coalesce(x, ''))) end as kept_sha256
from raw left join gone using (doc_id) left join kept using (doc_id)
"""
