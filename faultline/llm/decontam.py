"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are lower-cased runs of letters and digits.  Two fixed masks choose six of
eight and six of nine neighbouring tokens; the others may differ.  Hashes of the
chosen tokens of both sides are joined, and each hit fixes an alignment of one
item with one document.  An alignment is confirmed when some ``WINDOW`` tokens of
the item lie side by side with the document's and at most ``substitutions(WINDOW)``
of them differ, which is a similarity of 0.8 or more.

The two masks are lossless: wherever two of thirteen tokens differ, one mask fits
between them.  Items of 9 to 12 tokens must agree in every token, and items of
fewer tokens are too short to be evidence and take no part.

The benchmark's hashes are broadcast if there are at most ``max_broadcast`` of
them and joined by a shuffle if there are more.  Only hashes and positions of hits
are shuffled; texts move once, to be confirmed.

Cases: null and empty texts have no tokens.  Null ids are ids of their own.  Rows
that share an id are one document, the better alignment counts; ties go to the
smaller start.  Empty tables give an empty table.  Other columns pass or are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm._common import NULL_ID, id_key, keep

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, SHORTEST = 13, 9
_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def seeds(hashes: Column) -> Column:
    """For each mask, the hash at each position; null past the end."""
    last = F.size(hashes) - 1

    def one(mask: tuple[int, ...], which: int) -> Column:
        end = last - mask[-1]
        at = F.when(end >= 0, F.sequence(F.lit(0), end)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(which), *[F.get(hashes, i + m) for m in mask]))

    return F.concat(
        *[F.transform(one(mask, w), lambda h, i: F.struct(h.alias("seed"), i.alias("at"))) for w, mask in enumerate(MASKS)]
    )


def least_equal(n: Column) -> Column:
    """Tokens of a window that must agree: 11 of 13, all of shorter ones."""
    return F.when(n >= WINDOW, F.lit(WINDOW - WINDOW // 5)).otherwise(n)


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    max_broadcast: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_equal, n_tokens, start): confirmed overlaps, the best of each pair.

    n_equal of the item's n_tokens agree where its first token lies at token start.
    """
    bench = keep(
        items.select(id_key(F.col(item_id)).alias("item"), token_hashes(F.col(item_text)).alias("ih")).where(
            F.size("ih") >= SHORTEST
        ),
        "bench-tokens",
    )
    wanted = keep(bench.select("item", F.explode(seeds(F.col("ih"))).alias("s")).select("item", F.col("s.seed").alias("seed"), F.col("s.at").alias("ia")), "bench-seeds")
    if wanted.count() <= max_broadcast:
        wanted = F.broadcast(wanted)
    keyed = docs.select(id_key(F.col(doc_id)).alias("d"), F.col(text).alias("t"))
    found = keyed.select("d", token_hashes(F.col("t")).alias("h")).select("d", F.explode(seeds(F.col("h"))).alias("s"))
    hits = keep(
        found.select("d", F.col("s.seed").alias("seed"), F.col("s.at").alias("a"))
        .join(wanted, "seed")
        .select("d", "item", (F.col("a") - F.col("ia")).alias("start"))
        .distinct(),
        "bench-hits",
    )
    aligned = (
        keyed.join(hits.select("d").distinct(), "d", "left_semi")
        .select("d", token_hashes(F.col("t")).alias("h"))
        .join(hits, "d")
        .join(bench, "item")
        .select("d", "item", "start", "ih", F.transform("ih", lambda x, j: _equal("h", F.col("start") + j, x)).alias("e"))
    )
    n = F.size("e")
    width = F.least(n, F.lit(WINDOW))
    best = F.array_max(
        F.transform(F.sequence(F.lit(0), n - width), lambda j: F.aggregate(F.slice("e", j + 1, width), F.lit(0), lambda a, x: a + x))
    )
    confirmed = aligned.where(best >= least_equal(n)).select(
        "d", "item", "start", n.alias("n"), F.aggregate("e", F.lit(0), lambda a, x: a + x).alias("equal")
    )
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return (
        confirmed.groupBy("d", "item")
        .agg(F.max(F.struct("equal", (-F.col("start")).alias("s"), "n")).alias("b"))
        .select(
            back("d").alias("doc_id"),
            back("item").alias("item_id"),
            F.col("b.equal").cast("long").alias("n_equal"),
            F.col("b.n").cast("long").alias("n_tokens"),
            (-F.col("b.s")).cast("long").alias("start"),
        )
    )


def _equal(hashes: str, at: Column, wanted: Column) -> Column:
    """1 where the document's token hash at a place is the wanted one, else 0."""
    inside = F.when(at >= 0, F.get(F.col(hashes), at))
    return F.when(inside == wanted, 1).otherwise(0)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents that hold a passage of the benchmark."""
    bad = keep(overlaps(docs, items, text, doc_id).select(id_key(F.col("doc_id")).alias("_bad")).distinct(), "bench-bad")
    return docs.join(bad, id_key(docs[doc_id]) == bad["_bad"], "left_anti")


#: The same overlaps in DuckDB, from all pairs of equal tokens and without seeds.
ORACLE_SQL = """
with dt as (
    select doc_id, unnest(ts) as tok, generate_subscripts(ts, 1) - 1 as pos from (
        select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ts from documents)),
items as (
    select item_id, ts, len(ts) as n from (
        select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ts from benchmark)
    where len(ts) >= 9),
bt as (select item_id, n, unnest(ts) as tok, generate_subscripts(ts, 1) - 1 as ipos from items),
eq as (select doc_id, item_id, n, pos - ipos as start, ipos from dt join bt using (tok)),
diag as (select doc_id, item_id, n, start, count(*) as n_equal from eq group by all having count(*) >= least(n, 11)),
win as (
    select e.doc_id, e.item_id, e.start, e.ipos, d.n, d.n_equal,
        count(*) over (partition by e.doc_id, e.item_id, e.start order by e.ipos range between current row and 12 following) as c
    from eq e join diag d using (doc_id, item_id, start)),
ok as (
    select doc_id, item_id, start, n, n_equal, max(c) as c from win group by all
    having max(c) >= case when n >= 13 then 11 else n end)
select doc_id, item_id, n_equal, n as n_tokens, start from ok
qualify row_number() over (partition by doc_id, item_id order by n_equal desc, start) = 1
"""
