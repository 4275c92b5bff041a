"""The registered queries: DuckDB agrees, and the pipeline equals its stages one by one."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from test_exact import brute_groups, brute_lines, sha

import __spark_entry__
import corpus_pipeline
from faultline.llm import queries

DATA = "/root/testdata/sf0.001"


def same(got, want):
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda values: sorted(map(repr, values))
    assert rows(tuple(r[c] for c in names) for r in got.collect()) == rows(want.project(", ".join(names)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    for t in ("documents", "embeddings", "benchmark", "labels"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    same(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


def test_registered():
    names = __spark_entry__.queries()
    assert [f"op{n}_" for n in range(1, 11)] == [x[: x.index("_") + 1] for x in names if x.startswith("op")]
    assert names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline(spark, tmp_path):
    """run() equals the stages, each written and read again, on the test data."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] > sizes[3] >= sizes[4] == sizes[5] > 0
    rows = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(docs)


def brute_toxicity(rows, labels):
    """Scores by dictionaries of words: nearest 15 examples by cosine over all words, ties shared."""
    words = [Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for _, t in rows]
    place = {d: i for i, (d, _) in enumerate(rows)}
    taught = [(place[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    n_docs = Counter(w for c in words for w in c)
    held = [Counter(w for i, y in taught if y == label for w in words[i]) for label in (0, 1)]
    n = [sum(y == label for _, y in taught) for label in (0, 1)]
    part = lambda a, b: sum(x * math.log(x / (a + b)) for x in (a, b) if x)

    def weight(w):
        a, b = held[0][w], held[1][w]
        if not a + b:
            return math.log(1 + len(rows)) + 1
        return (math.log((1 + len(rows)) / (1 + n_docs[w])) + 1) * (1 + max(2 * (part(a, b) + part(n[0] - a, n[1] - b) - part(*n)), 0) ** 0.75 / 2)

    weights = {w: weight(w) for c in words for w in c}

    def unit(c):
        v = {w: (1 + math.log(k)) * weights[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = [unit(c) if c else {} for c in words]
    scores = []
    for v in vectors:
        near = sorted(((round(sum(x * vectors[e].get(w, 0) for w, x in v.items()), 9), y) for e, y in taught), reverse=True)
        kth = near[14][0] if len(near) > 15 else 0
        near = [(c, y) for c, y in near if c >= kth and c > 0]
        votes = sum(c for c, _ in near)
        scores.append((sum(c * y for c, y in near) + 0.1 * n[1] / sum(n)) / (votes + 0.1) if near else n[1] / sum(n))
    return scores


def brute_contaminated(text, items):
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    words = split(text)
    for item in map(split, items):
        width = min(len(item), 13)
        for start in range(-len(item) + 1, len(words)) if len(item) >= 9 else ():
            same = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(item)]
            if any(sum(same[j : j + width]) >= (11 if len(item) >= 13 else width) for j in range(len(item) - width + 1)):
                return True
    return False


def test_pipeline_against_brute_force(spark, texts, tmp_path):
    """The ids and digests of run() on awkward rows equal five plain loops, one after the other."""
    rng = random.Random(6)
    clean = lambda n: " ".join(f"plain{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    rows = [(d, t) for d, t in texts if d is not None and d != 14 and len({x for x, _ in texts if x == d}) == 1]
    rows = list({d: (d, t) for d, t in rows}.values())
    foul = lambda: " ".join(rng.choice(["vilea", "vileb", "vilec", *clean(3).split()]) for _ in range(30))
    rows += [(1000 + i, foul() if i % 3 == 0 else clean(30)) for i in range(90)]
    labels = [(1000 + i, int(i % 3 == 0)) for i in range(60)]
    item = next(t for d, t in rows if d == 19).split()[20:60]
    items = [" ".join(item), "of no use"]
    rows += [(2000, clean(40) + " " + " ".join(item[5:25]) + " " + clean(10)), (2001, clean(60))]
    spark.createDataFrame([(d, t, "en", f"s{d % 5}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [r for r, s in zip(rows, brute_toxicity(rows, labels)) if s < 0.7]
    assert len(kept) < len(rows)
    kept = [(d, None if dict(kept)[d] is None else "\n".join(left)) for d, _, left in brute_lines(kept)]
    near = {d for d, _, _, stays in brute_groups(kept, 80) if not stays}
    assert near
    kept = [(d, t) for d, t in kept if d not in near]
    left = [(d, t) for d, t in kept if not brute_contaminated(t, items)]
    assert len(left) < len(kept) and 2000 not in dict(left) and 2001 in dict(left)
    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in left:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(t or "")))
    assert got == sorted(want)
