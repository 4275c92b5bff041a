"""Line dedup with DataFrame functions only.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of at least ``min_chars`` code points that at least ``min_docs`` documents
hold lose all their lines, except in the largest document id that holds them.

Keys are counted by two independent 64-bit hashes.  Only hashes are shuffled to
count and to look up; each text moves once, to meet its dropped positions, and is
put together from the slices between them, in time linear in its length.

Cases: a null or empty text is one empty line and stays as it is.  Rows that
share an id count as one document.  A null id counts as one document below all
others.  An empty table gives an empty table.  Other columns pass through,
whatever their names; internal columns start with ``_``, in a separate projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm._common import SPACE, ascii_lower, keep, row_key


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int) -> Column:
    """One struct of two hashes per line, null where the key is too short."""
    keys = F.transform(split_lines(text), lambda line: F.trim(line, F.lit(SPACE)))
    long_keys = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, ascii_lower(k)))
    return F.transform(
        long_keys,
        lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))),
    )


def dropped_positions(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """(_d, _h, _drop): for each row that loses lines, their positions from 0."""
    lines = keep(
        docs.select(*row_key(F.col(doc_id), F.col(text)), line_hashes(F.col(text), min_chars).alias("_k"))
        .select("_d", "_h", F.posexplode("_k").alias("_pos", "_key"))
        .where("_key is not null")
        .select("_d", "_h", "_pos", F.col("_key.h1").alias("_h1"), F.col("_key.h2").alias("_h2")),
        "lines",
    )
    common = keep(
        lines.groupBy("_h1", "_h2")
        .agg(F.countDistinct("_d").alias("_n"), F.max("_d").alias("_keeper"))
        .where(F.col("_n") >= min_docs)
        .select("_h1", "_h2", "_keeper"),
        "common-lines",
    )
    return (
        lines.join(common, ["_h1", "_h2"])
        .where("_d <> _keeper")
        .groupBy("_d", "_h")
        .agg(F.collect_set("_pos").alias("_drop"))
    )


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """docs with the repeated lines gone from ``text``, plus n_lines and n_dropped.

    Input columns named n_lines or n_dropped are replaced.
    """
    drops = dropped_positions(docs, text, doc_id, min_chars, min_docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, *row_key(F.col(doc_id), F.col(text)))
    source = F.col("_row").getField(text)
    # columns of their own, so that a text is split once and not for each of its lines
    cut = keyed.join(drops, ["_d", "_h"], "left").select(
        "_row",
        split_lines(source).alias("_lines"),
        F.array_sort("_drop").alias("_drop"),
    )
    edges = cut.select(
        "*", F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size("_lines"))).alias("_edges")
    )
    # the lines between two dropped ones, in order
    between = F.transform(
        F.sequence(F.lit(0), F.size("_edges") - 2),
        lambda i: F.slice("_lines", F.get("_edges", i) + 2, F.get("_edges", i + 1) - F.get("_edges", i) - 1),
    )
    left = F.when(F.col("_drop").isNull(), source).otherwise(F.array_join(F.flatten(between), "\n"))
    out = [left.alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return edges.select(
        *out,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def kept_digest(docs: DataFrame) -> DataFrame:
    cut = dedup_lines(docs.select("doc_id", "text"))
    return cut.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
