"""Secret scans with corpus-wide ownership frequency.

Three patterns give the base spans of a text, leftmost and non-overlapping per
kind: ``assign`` (a credential's name, a sign, a value of 8 or more characters),
``access`` (AKIA and capitals or digits, 16 or more in all) and ``hex`` (32 or
more hexadecimal digits).  Offsets are code points, ends exclusive.

The hash of every candidate's value is then counted over the whole corpus by
distinct repositories and owners.  A value that at least ``copied_owners``
owners or ``copied_repos`` repositories hold is a copied example; any other is
owner-specific and looks live.  Each base span gets a second span over its
value that says which: ``example`` or ``live``.

Repository and owner are columns that the caller names.  The table ``documents``
has neither; its ``source`` stands for both in ``secret_digest``, so there the two
counts are one, and a value that only one source holds, however often, is its own.

Hashes are counted with partial sums and joined by plain exchanges, which
adaptive execution can split; texts are never shuffled.

Cases: a null text is empty and holds nothing.  A null repository or owner
counts as one of its own.  Repeated rows are counted as the documents they are
but add no repository or owner.  Ties cannot arise: spans are ordered by start,
then kind.  An empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._common import keep

KINDS = ("assign", "access", "hex", "live", "example")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")


def base_spans(text: str) -> list[tuple[int, int, int, str, int]]:
    """(start, kind, end, value, value's start) by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2], m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0], m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a run of 32 or more digits starts where the run of any length does
    found += [(m.start(), 2, m.end(), m[0], m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_SCHEMA = """doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base string,
 candidates array<struct<start:int,kind:int,end:int,value_start:int,hash:string>>"""


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("hash", pa.string())])
    )
    for batch in batches:
        ids, repos, owners, texts = batch.columns
        counts: list[list[int]] = [[], [], []]
        base, rows = [], []
        for text in texts.to_pylist():
            spans = base_spans(text or "")
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in spans))
            base.append(joined([s[:3] for s in spans]))
            rows.append(
                [
                    {"start": s, "kind": k, "end": e, "value_start": v, "hash": hashlib.sha256(value.encode()).hexdigest()}
                    for s, k, e, value, v in spans
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [ids, repos, owners, *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(rows, kind)],
            names=["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base", "candidates"],
        )


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repo: str = "source", owner: str = "source") -> DataFrame:
    """One row per document with its base spans and the hashes of their values."""
    columns = [F.col(doc_id).cast("long"), F.col(repo).cast("string"), F.col(owner).cast("string"), F.col(text)]
    return docs.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(_scan, _SCHEMA)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_docs, n_repos, n_owners) of every candidate value in the corpus."""
    each = found.select("doc_id", "repo", "owner", F.explode("candidates.hash").alias("hash"))
    per = each.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return per.groupBy("hash").agg(
        F.sum("n").alias("n_docs"),
        F.countDistinct(name("repo")).alias("n_repos"),
        F.countDistinct(name("owner")).alias("n_owners"),
    )


def scan(docs: DataFrame, copied_repos: int = 3, copied_owners: int = 3, **columns: str) -> DataFrame:
    """One row per document: base spans, and all spans with each value's verdict."""
    found = keep(candidates(docs, **columns), "secrets")
    copied = keep(
        ownership(found)
        .where((F.col("n_repos") >= copied_repos) | (F.col("n_owners") >= copied_owners))
        .select("hash", F.lit(True).alias("copied")),
        "secret-owners",
    )
    # equal rows have equal spans, so a document is known by its id and its base spans
    each = found.select("doc_id", "base", F.explode("candidates").alias("c")).select("doc_id", "base", "c.*")
    judged = (
        each.join(copied, "hash", "left")
        .select(
            F.coalesce("doc_id", F.lit(-(2**63))).alias("_d"),
            "base",
            F.struct("value_start", F.when(F.col("copied"), 4).otherwise(3).alias("kind"), F.col("end"), "hash").alias("v"),
        )
        .groupBy("_d", "base")
        .agg(F.collect_set("v").alias("verdicts"))
    )
    left = found.withColumn("_d", F.coalesce("doc_id", F.lit(-(2**63))))
    both = left.join(judged, ["_d", "base"], "left")
    # an assigned value ends where its span does; quotes after it are not part of the match
    spans = F.array_sort(
        F.concat(
            F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))),
            F.transform(
                F.coalesce("verdicts", F.array().cast("array<struct<value_start:int,kind:int,end:int,hash:string>>")),
                lambda v: F.struct(v["value_start"].alias("start"), v["kind"].alias("kind"), v["end"].alias("end")),
            ),
        )
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    text_of = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return both.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base",
        F.array_join(F.transform(F.array_distinct(spans), text_of), ",").alias("spans"),
        F.coalesce(F.size(F.filter("verdicts", lambda v: v["kind"] == 3)), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.size(F.filter("verdicts", lambda v: v["kind"] == 4)), F.lit(0)).cast("long").alias("n_examples"),
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text", "source")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_live", "n_examples"
    )


_ASSIGN_SQL = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches of a kind and their values; a place follows from the lengths of what lies before."""
    return f"""
    select doc_id, source, {kind} as kind, i, m, v, gaps, lens from (
        select doc_id, source, unnest(regexp_extract_all(t, '{pattern}')) as m, unnest(regexp_extract_all(t, '{pattern}', {group})) as v,
            unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) as i,
            list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) as gaps,
            list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) as lens
        from doc) where length(v) >= {least}"""


#: The same in DuckDB.
ORACLE_SQL = f"""
with doc as (select doc_id, source, coalesce(text, '') as t from documents),
hit as ({_found_sql(0, _ASSIGN_SQL, 2, 8)}
    union all {_found_sql(1, 'AKIA[A-Z0-9]+', 0, 16)}
    union all {_found_sql(2, '[0-9a-f]+', 0, 32)}),
span as (
    select *, s + length(m) as e from (
        select doc_id, source, kind, m, v, cast(list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) as bigint) as s from hit)),
owned as (select v, count(distinct source) + cast(bool_or(source is null) as integer) as n from span group by v),
verdict as (select distinct doc_id, e - length(v) as s, case when n >= 3 then 4 else 3 end as kind, e, v from span join owned using (v)),
whole as (select doc_id, s, kind, e from span union select doc_id, s, kind, e from verdict),
named as (
    select doc_id, string_agg(['assign', 'access', 'hex', 'live', 'example'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e) as spans from whole group by doc_id),
base as (
    select doc_id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
        string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind) as spans from span group by doc_id),
judged as (select doc_id, count(*) filter (kind = 3) as n_live, count(*) filter (kind = 4) as n_examples from verdict group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base.spans, '')) as base_sha256,
    coalesce(named.spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_examples, 0) as n_examples
from documents d left join base using (doc_id) left join named using (doc_id) left join judged using (doc_id)
"""
