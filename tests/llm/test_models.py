"""Operators that learn: held-out accuracy, exact search, and defined results for awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from faultline.llm import decontam, lmscore, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


def auc(pairs):
    pairs = sorted(pairs)
    ranks, i = {}, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        ranks[pairs[i][0]] = (i + j + 1) / 2
        i = j
    good = [ranks[s] for s, y in pairs if y]
    n, m = len(good), len(pairs) - len(good)
    return (sum(good) - n * (n + 1) / 2) / (n * m)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    scored = toxicity.score(docs, labels).cache()
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels.where("toxic is not null"), "doc_id").select("score", "toxic", "predicted").collect()
    assert len(rows) > 500
    assert auc([(r.score, r.toxic) for r in rows]) > 0.9
    accuracy = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert accuracy > 0.9
    scored.unpersist()


def test_toxicity_of_awkward_rows(docs, no_docs, spark, texts):
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in toxicity.score(docs, labels.limit(0)).collect())
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_toxicity_search_is_exact_and_skips_blocks():
    """Cosines of the nearest examples equal brute force, ties included, though not all blocks are scored."""
    rng = np.random.default_rng(0)
    kinds = [[f"{k}{chr(97 + i)}" for i in range(20)] for k in ("am", "bm", "cm", "dm", "em", "fm")]
    common = [f"zz{chr(97 + i)}" for i in range(5)]
    made = lambda: " ".join(rng.choice(kinds[rng.integers(6)], 8).tolist() + rng.choice(common, 3).tolist())
    texts = [made() for _ in range(700)]
    texts += texts[:40]
    row, terms, counts = toxicity.batch_terms(texts)
    every, place = np.unique(terms, return_inverse=True)
    frequency = np.bincount(place).astype(float)
    label = np.arange(len(texts)) % 2
    index = toxicity.build(every, place, counts.astype(float), np.bincount(row), label, np.arange(len(texts)), frequency, 740, {0: 370, 1: 370}, 15)
    few = toxicity.build(every, place, counts.astype(float), np.bincount(row), label, np.arange(len(texts)), frequency, 740, {0: 370, 1: 370}, 740)
    asks = [made() for _ in range(60)] + [None, "", "unknown"] + texts[:5]
    found, scored = index.cosines(len(asks), *toxicity.batch_terms(asks))
    whole, all_ = few.cosines(len(asks), *toxicity.batch_terms(asks))
    assert scored < 0.85 * len(asks) * index.highest.shape[1] and all_ > scored
    for a, b in zip(found, whole):
        kth = np.sort(b)[-15]
        near = np.flatnonzero((b >= kth) & (b > 0))
        assert set(near) == set(np.flatnonzero((a >= np.sort(a)[-15]) & (a > 0))) and np.allclose(a[near], b[near])
        assert (a <= b + 1e-9).all()
    # the cosines themselves: dictionaries of words, and no arrays
    vector = {}
    for r, t, n in zip(row, terms, counts):
        vector.setdefault(r, {})[t] = (1 + math.log(n)) * index.weight[np.searchsorted(every, t)]
    unit = {r: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for r, v in vector.items()}
    for r in range(3):
        got = dict(zip(few.ids.tolist(), few.cosines(1, *toxicity.batch_terms([texts[r]]))[0][0]))
        for e in range(0, 740, 37):
            assert got[e] == pytest.approx(sum(x * unit[e].get(t, 0) for t, x in unit[r].items()), abs=1e-8)


def toxic_corpus(spark, kinds=1):
    """Clean prose, and short toxic texts of several kinds with one telling word each."""
    rng = __import__("random").Random(1)
    prose = lambda n: [f"word{rng.randrange(3000)}" .translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)]
    taught = [i for i in range(2000) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(2000) if i not in set(taught)]
    name = lambda j: "vile" + "abcdefghijklmnopqrstuvwxyz"[j // 26] + "abcdefghijklmnopqrstuvwxyz"[j % 26]
    rows, labels = [], []
    for n, i in enumerate(taught[:800]):
        rows.append((i, " ".join(prose(20) + [name(n // 4 % kinds)] * 3 if n % 4 == 0 else prose(30 if n % 4 > 1 else 2000))))
        labels.append((i, None, int(n % 4 == 0)))
    return prose, name, held, rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_one_listed_word_does_not_make_a_long_clean_text_toxic(spark):
    prose, name, held, rows, labels = toxic_corpus(spark)
    clean = " ".join(prose(26_000))
    rows += [(held[0], clean), (held[1], clean + " " + name(0)), (held[2], " ".join(prose(30)) + " vileable"), (held[3], " ".join(prose(20) + [name(0)] * 3))]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert [got[held[j]].predicted for j in range(4)] == [0, 0, 0, 1]
    assert abs(got[held[1]].score - got[held[0]].score) < 0.3


def test_kinds_of_toxicity_below_any_rate_are_found(spark):
    """100 kinds, each in 1% of the toxic rows: its examples are found, and cosines and scores equal brute force."""
    prose, name, held, rows, labels = toxic_corpus(spark, kinds=100)
    rows += [(held[j], " ".join([name(j)] * 3)) for j in range(100)] + [(held[100 + j], " ".join(prose(10) + [name(j)] * 3)) for j in range(20)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    words, toxic = {i: Counter(t.split()) for i, t in rows}, {r.doc_id: r.toxic for r in labels.collect()}
    for j in range(100):
        assert {e.doc_id for e in got[held[j]].evidence} == {i for i in toxic if name(j) in words[i]}

    docs = Counter(w for c in words.values() for w in c)
    holders = [Counter(w for i, y in toxic.items() if y == label for w in words[i]) for label in (0, 1)]
    n = [list(toxic.values()).count(y) for y in (0, 1)]
    part = lambda a, b: sum(x * math.log(x / (a + b)) for x in (a, b) if x)

    def weight(w):
        idf, (a, b) = math.log((1 + len(rows)) / (1 + docs[w])) + 1, (holders[0][w], holders[1][w])
        if not a + b:
            return math.log(1 + len(rows)) + 1
        return idf * (1 + max(2 * (part(a, b) + part(n[0] - a, n[1] - b) - part(*n)), 0) ** 0.75 / 2)

    def vector(c):
        v = {w: (1 + math.log(k)) * weight(w) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {i: vector(words[i]) for i in toxic}
    for i in held[95:120]:
        query = vector(words[i])
        near = sorted(((sum(x * v.get(w, 0) for w, x in query.items()), y) for v, y in ((examples[e], toxic[e]) for e in toxic)), reverse=True)[:15]
        votes = sum(c for c, _ in near)
        want = (sum(c * y for c, y in near) + 0.1 * n[1] / sum(n)) / (votes + 0.1)
        assert got[i].score == pytest.approx(want, abs=1e-6)


def test_lm_scores(tables):
    docs, labels = tables
    rows = lmscore.score(docs, labels).collect()
    assert len(rows) == docs.count()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [(-r.score, quality[r.doc_id]) for r in rows if r.held_out and quality.get(r.doc_id) is not None]
    assert auc(held) > 0.7


def brute_lm(texts, teach):
    """(doc_id, tokens, score) of every row, each judged by all other rows."""
    tokens = [re.findall(r"\w+|[^\w\s]", (t or "").lower()) for _, t in texts]
    streams = [["<end>", *w, "<end>"] if w else [] for w in tokens]
    pairs = [Counter(zip(s, s[1:])) for s in streams]
    seconds = [Counter(s[1:]) for s in streams]
    delta = lmscore.MU / (len({w for s in streams for w in s}) + 1)
    every = [sum(c, Counter()) for c in (pairs, seconds)]
    good = [d in teach for d, _ in texts]
    right = [sum((c for c, g in zip(of, good) if g), Counter()) for of in (pairs, seconds)]
    out = Counter()
    for i, (d, _) in enumerate(texts):
        total = 0.0
        for a, b in zip(streams[i], streams[i][1:]):
            for sign, model, mine in ((1, every, True), (-1, right, good[i])):
                c = lambda which, key: model[which][key] - (mine and (pairs, seconds)[which][i][key])  # noqa: B023
                total += sign * math.log2((c(0, (a, b)) + delta) / (c(1, a) + lmscore.MU))
        out[(d, len(tokens[i]), round(total / (len(streams[i]) - 1), 6) + 0.0 if streams[i] and teach else 0.0)] += 1
    return out


def lm_rows(docs, labels, **settings):
    return Counter((r.doc_id, r.n_tokens, round(r.score, 6) + 0.0) for r in lmscore.score(docs, labels, **settings).collect())


def test_lm_scores_against_brute_force(docs, spark, texts):
    short = [(d, t) for d, t in texts if len(t or "") < 20_000]
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 1), (10, 1, 0), (12, 0, 0), (20, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    teach = {d for d in (5, 9, 10, 20) if __import__("zlib").crc32(str(d).encode()) % 3 != 1}
    assert teach
    few = docs.where("text is null or length(text) < 20000")
    want = brute_lm(short, teach)
    for most in (500_000, 0, 50):  # what is broadcast has no part in a score
        assert lm_rows(few, labels, max_broadcast=most) == want


def test_lm_scores_of_a_text_of_many_batches(docs, spark, texts):
    """The longest text, and rows in many partitions, count as they do in one batch."""
    labels = spark.createDataFrame([(d, 1, 0) for d in (5, 9, 10, 14, 100, 101, 104)], "doc_id long, quality int, toxic int")
    whole = lm_rows(docs, labels)
    assert len({s for _, _, s in whole}) > 20 and sum(whole.values()) == len(texts)
    assert lm_rows(docs.repartition(7), labels, max_broadcast=50) == whole


def test_a_text_that_occurs_twice_stands_apart(spark):
    rng = __import__("random").Random(4)
    rows = [(i, " ".join(rng.choice([f"w{rng.randrange(300)}", f"r{rng.random()}"]) for _ in range(60))) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    twice = [got[i] for i in (*range(5), *range(200, 205))]
    assert min(twice) > max(s for i, s in got.items() if 5 <= i < 200)


def test_lm_scores_beyond_any_fixed_number_of_words(spark):
    """40,000 words, each in one pair of texts: every word and bigram keeps a count of its own."""
    texts = [(i, " ".join(f"w{j}" for j in range(i // 2 * 400, i // 2 * 400 + 400))) for i in range(200)]
    taught = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 3 != 1][-1]
    labels = spark.createDataFrame([(taught, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in lmscore.score(spark.createDataFrame(texts, "doc_id long, text string"), labels).collect()}
    mu, delta = lmscore.MU, lmscore.MU / (40_000 + 2)
    twin = taught ^ 1  # its other documents hold each of its words once, and one of the target's does too
    inner = math.log2((1 + delta) / (1 + mu)) - math.log2((1 + delta) / (1 + mu))
    start = math.log2((1 + delta) / (199 + mu)) - math.log2((1 + delta) / (1 + mu))
    assert got[twin] == pytest.approx((400 * inner + start) / 401, abs=1e-9) and got[twin] < 0
    other = taught ^ 4  # nothing of the target's
    want = 400 * (math.log2((1 + delta) / (1 + mu)) - math.log2(delta / mu)) + math.log2((1 + delta) / (199 + mu)) - math.log2(delta / (1 + mu))
    assert got[other] == pytest.approx(want / 401, abs=1e-9)


def test_lm_scores_of_nothing(docs, no_docs, spark, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in lmscore.score(docs, labels).collect()] == [0.0] * len(texts)
    assert lmscore.score(no_docs, labels).count() == 0


def test_decontamination(docs, no_docs, spark, texts):
    long = next(t for d, t in texts if d == 5).split()
    item = long[10:40]
    changed = [w if i not in (4, 9, 17, 24) else "changed" for i, w in enumerate(item)]
    items = [(0, " ".join(item)), (1, " ".join(changed)), (2, "too short an item"), (3, None), (None, " ".join(item[:10])), (4, " ".join(f"no{i}" for i in range(30)))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, d int")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()}
    holders = {d for d, t in texts if t and " ".join(item).lower() in t.lower()}
    assert {d for d, i in got if i == 0} >= holders and {d for d, i in got if i == 1} >= holders and {d for d, i in got if i is None} >= holders
    assert not any(i in (2, 3, 4) for _, i in got)
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and not {r.doc_id for r in left.collect()} & holders
    assert decontam.overlaps(no_docs, bench).count() == 0 and decontam.overlaps(docs, bench.limit(0)).count() == 0
    shuffled = decontam.overlaps(docs, bench, max_broadcast=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, decontam.overlaps(docs, bench).collect()))


def test_masks_are_lossless():
    from itertools import combinations

    for gone in combinations(range(13), 2):
        assert any(all(s + m not in gone for m in mask) for mask in decontam.MASKS for s in range(13 - mask[-1]))


def test_portions_of_texts():
    from faultline.llm import words

    assert list(words.portions([3, None, 4, 100, 1, 1, 1], 3, 10)) == [(0, 3), (3, 4), (4, 7)]
    assert list(words.portions([], 3, 10)) == [] and list(words.portions([1] * 5, 2, 10)) == [(0, 2), (2, 4), (4, 5)]
