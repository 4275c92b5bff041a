"""Each operator whose contract fixes its rows, against brute force on awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from faultline.llm import bpe, lines, minhash, queries, secretscan, sharding, suffixes, topk
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def brute_lines(texts):
    """(doc_id, lines, lines that stay) of every row."""
    below = -(2**63)
    held = defaultdict(set)
    keys = lambda t: [k if len(k) >= 20 else None for k in (x.strip(SPACE).translate(LOWER) for x in (t or "").split("\n"))]
    for d, t in texts:
        for k in keys(t):
            if k is not None:
                held[k].add(below if d is None else d)
    for d, t in texts:
        own = below if d is None else d
        each = list(zip((t or "").split("\n"), keys(t)))
        yield d, len(each), [x for x, k in each if k is None or len(held[k]) < 3 or max(held[k]) == own]


def test_line_dedup(docs, texts):
    want = Counter((d, n, n - len(left), sha("\n".join(left))) for d, n, left in brute_lines(texts))
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 10
    assert rows_of(lines.kept_digest(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_line_dedup_of_a_text_of_many_lines(spark):
    """400 KB in 40,000 lines, every other one repeated: time follows the length."""
    import time

    def texts(n):
        line = lambda d, i: f"a line that repeats {i}" if i % 2 else f"own {d} {i}"
        return [(d, "\n".join(line(d, i) for i in range(n))) for d in range(3)]

    took = []
    for n in (2000, 5000, 40_000):
        began = time.time()
        rows = texts(n)
        got = {r.doc_id: r for r in lines.kept_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        took.append(time.time() - began)
        for d, t in rows:
            left = t.split("\n")[:: 1 if d == 2 else 2]
            assert got[d].n_lines == n and got[d].n_dropped == n - len(left) and got[d].kept_sha256 == sha("\n".join(left))
    assert took[2] < 8 * took[1] + 5


def test_line_dedup_keeps_columns(docs, no_docs):
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.kept_digest(no_docs).count() == 0


def test_sharding(spark, docs, texts, no_docs):
    got = sharding.shard_digest(docs).collect()
    want = Counter((d, len((t or "").encode()) + (1), zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_digest(no_docs).count() == 0


def test_sharding_is_a_fixed_shuffle(docs):
    runs = [sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in sharding.shard_digest(docs.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
    plain = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "3")
    runs.append(sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in sharding.shard_digest(docs).collect()))
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", plain)
    assert runs[0] == runs[2]
    order = sharding.fisher_yates(50, 3)
    assert sorted(order) == list(range(50)) and list(order) != list(range(50))


def test_sharding_of_awkward_columns(spark, tmp_path):
    """Clashing names, and one id (or none) for every row: rows still scatter and keep their columns."""
    frame = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('t', id) as text", "id as _bucket", "id as _hash", "map('a', id) as m", "1 as shard", "2 as slot")
    out = sharding.write_shards(frame, str(tmp_path / "s"), bucket_bytes=200)
    assert out.columns == ["doc_id", "text", "_bucket", "_hash", "m", "size", "text_crc32", "slot", "shard"]
    rows = out.select("text", "_bucket", "_hash", "shard", "slot").collect()
    assert sorted(r.text for r in rows) == sorted(f"t{i}" for i in range(3000)) and all(r.text == f"t{r._bucket}" and r._hash == r._bucket for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == 3000


def brute_suffix(texts, length):
    raw = [(t or "").encode() for _, t in texts]
    starts = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = Counter()
    for (d, _), x in zip(texts, raw):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if starts[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[(d, len(x), sum(gone), spans, sha(left))] += 1
    return out


def test_suffix_dedup(docs, texts, no_docs):
    got = rows_of(suffixes.repeat_digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_suffix(texts, 200)
    assert sum(n for k, n in want.items() if k[2]) > 10
    assert got == want
    assert suffixes.repeat_digest(no_docs).count() == 0


def sets_of(texts):
    out = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def brute_groups(texts, percent):
    sets = sets_of(texts)
    ids = [-(2**63) if d is None else d for d, _ in texts]
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    shared, holders = Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            for j in holders[x]:
                shared[j, i] += 1
            holders[x].append(i)
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            x, y = sorted((root(ids[i]), root(ids[j])))
            parent[y] = x
    back = lambda d: None if d == -(2**63) else d
    return Counter((back(d), len(s), back(root(d) if s else d), root(d) == d if s else True) for d, s in zip(ids, sets))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup(docs, texts, no_docs, percent):
    got = rows_of(minhash.near_groups(docs, percent=percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_groups(texts, percent)
    assert minhash.near_groups(no_docs).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_near_dedup_on_test_data(spark, sf):
    """Recall and precision of the links are 1 on these tables: groups equal those of all pairs."""
    frame = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = rows_of(minhash.near_groups(frame), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_groups(texts, 85)


def test_near_dedup_chain_is_one_group(spark):
    """Neighbours in a chain are linked, its ends are not; all share one smallest id."""
    words = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(12):
        rows.append((50 - i, " ".join(f"z{i}_{j}" if j < i * 6 else w for j, w in enumerate(words))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(minhash.near_groups(frame), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows, 85)


def test_bpe(docs, texts, no_docs):
    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t in texts:
        ids = library.encode_ordinary(t or "")
        want[(d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(t or ""))] += 1
    got = bpe.token_digest(docs, queries.RANKS, public_tokenizers.PATTERN)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.token_digest(no_docs, queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_test_data(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(frame.select("doc_id", "text", F.upper("text").alias("n_tokens")), queries.RANKS, public_tokenizers.PATTERN)
    for r in coded.where("doc_id % 5 = 0").collect():
        ids = library.encode_ordinary(r.text)
        assert bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in ids)
    back = bpe.decode(coded.join(frame.select("doc_id", "text"), "doc_id") if "text" not in coded.columns else coded, queries.RANKS, public_tokenizers.PATTERN)
    assert back.where("decode(decoded, 'UTF-8') <> text or decoded is null").isEmpty()


def brute_spans(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                found.append((m.start(), kind, f"{('', 'access', 'hex')[kind]}:{m.start()}:{m.end()}"))
    return sorted(found)


def test_secrets(docs, texts, no_docs):
    want = Counter()
    for d, t in texts:
        spans = brute_spans(t or "")
        n = Counter(k for _, k, _ in spans)
        want[(d, n[0], n[1], n[2], sha(",".join(x for _, _, x in spans)))] += 1
    got = secretscan.secret_digest(docs)
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    for r in got.collect():
        if r.n_assign + r.n_access + r.n_hex:
            each = r.spans.split(",")
            assert sum(s.split(":")[0] in ("assign", "access", "hex") for s in each) == r.n_assign + r.n_access + r.n_hex
            assert r.n_live + r.n_examples >= 1
        else:
            assert r.spans == ""
    assert secretscan.secret_digest(no_docs).count() == 0


def test_secret_copies_are_examples(spark):
    rows = [(i, f'token = "CopiedValue{1 if i < 6 else i}00"', f"repo{i}") for i in range(8)]
    got = {r.doc_id: (r.n_live, r.n_examples) for r in secretscan.secret_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (0, 1) for i in range(6)) and got[6] == got[7] == (1, 0)


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 7 + j * 13) % 23 - 11) / 9.0 for j in range(8)]) for i in range(160)]
    rows += [(200, [1.0] * 8), (201, [1.0] * 8), (200, [1.0] * 8), (250, None), (300, [nan] * 8), (350, [inf] + [0.0] * 7), (400, [None] + [0.0] * 7)]
    rows += [(450, [0.5, 0.25]), (451, [0.5, -0.25]), (500, []), (None, [1.0] * 8), (550, [3e38] * 8), (551, [3e38] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, block int, q int")
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in ((r.vec_id, r.embedding) for r in frame.collect()) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in {i: v for i, v in good if i % 50 == 0 and i < 550}.items():
        near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        clamp = lambda s: max(min(s, 2**63 - 1), -(2**63))
        want |= {(q, n + 1, i, clamp(-s)) for n, (s, i) in enumerate(near[:5])}
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, block_rows=16).collect()
    mine = [tuple(r) for r in got if r.query_id < 550 and r.query_id != 550]
    few = topk.top_k(frame, F.col("vec_id") % 50 == 0, block_rows=16, chunk_queries=3)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, got))
    strip = lambda rows: sorted(r for r in rows if abs(r[3]) < 2**62)
    assert strip(mine) == strip(want) and len(mine) == len(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def packed(vectors, first=0):
    import numpy as np

    ids = np.arange(first, first + len(vectors), dtype="<i8")
    return {"dim": vectors.shape[1], "n": len(vectors), "ids": ids.tobytes(), "vectors": vectors.astype("<i8").tobytes()}


def test_top_k_skips_blocks():
    """Noisy vectors about axes: most blocks are never scored, and the k-th score passes from batch to batch."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.integers(-12, 13, (1280, 16))
    vectors[np.arange(1280), np.arange(1280) // 80] += rng.integers(180, 260, 1280)
    queries = vectors[[5, 300, 901]]
    search = topk.Search(np.array([5, 300, 901]), queries, np.full(3, -(2**63)), 5)
    blocks = [packed(vectors[b : b + 16], b) for b in range(0, 1280, 16)]
    for i in range(0, 80, 20):
        search.visit(blocks[i : i + 20])
    want = []
    for q, v in zip((5, 300, 901), queries):
        order = sorted((-int(v @ w), i) for i, w in enumerate(vectors) if i != q)[:5]
        want += [(q, i, -s) for s, i in order]
    assert sorted(map(tuple, zip(*(x.tolist() for x in search.found())))) == sorted(want)
    assert search.pairs == 240 and search.scored < 120
    seeded = topk.Search(np.array([5, 300, 901]), queries, search.least, 5)
    seeded.visit(blocks)
    assert seeded.scored < 30


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_of_mutated_group(spark, percent):
    """One large group whose members are near some others and far from most: no link may be lost."""
    import random

    rng = random.Random(8)
    base = [f"b{rng.randint(0, 5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        words = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"c{rng.randint(0, 99999)}"
        rows.append((i, " ".join(words[: rng.choice([150, 150, 150, 120])])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(minhash.near_groups(frame, percent=percent), "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows, percent)


def test_shared_counts():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-3000, 3000, rng.integers(1, 4000))) for _ in range(20)]
    got = minhash.shared_counts(sets[:7], sets[7:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[7:]] for a in sets[:7]]
