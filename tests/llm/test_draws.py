"""Importance resampling, hard negatives and fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import hard_negatives, importance, queries, syncmers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- importance resampling


def plain_features(text, longest):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent, least_words, buckets, longest):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, text in table for f in plain_features(text, longest)[1]) for table in (docs, target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for i, text in docs:
        w, f = plain_features(text, longest)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least_words))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: percent * len(able) // 100]
    left, result = list(drawn), []
    for r in out:
        rank = None
        if r in left:
            rank = drawn.index(r) + 1 + (drawn.count(r) - left.count(r))
            left.remove(r)
        result.append((*r[:4], rank))
    return sorted(result, key=repr)


def some_texts(seed=3):
    r = random.Random(seed)
    pool = ["the", "Cat", "sat-on", "MAT's", "été", "語日", "İx", "a1b2", "_", "\x7f", "--", "\U0001f600"]
    data = [(i, " ".join(r.choice(pool) for _ in range(r.choice([0, 1, 5, 30, 60])))) for i in r.sample(range(10**6), 120)]
    return [*data, (None, "x " * 30), (None, None), (7, None), (8, ""), (9, "  \n"), (10, "long " * 50000), (11, "ties " * 25), (11, "ties " * 25), (11, "ties " * 25)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_the_plain_version(spark, longest, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 500)
    monkeypatch.setattr(importance, "MEMO", 4)
    data, target = some_texts(), [(1, "the cat sat"), (2, None), (3, "été été mat")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5).withColumn("weight", F.lit("x")).withColumn("rank", F.lit(1))
    wanted = spark.createDataFrame(target, "item_id long, text string")
    for percent in (0, 35, 100):
        assert rows(importance.resample(docs, wanted, percent, buckets=50, longest=longest)) == plain_resample(data, target, percent, 20, 50, longest)


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame(some_texts(), "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(importance.resample(docs, none)) == plain_resample(some_texts(), [], 10, 20, 10000, 1)
    assert rows(importance.resample(none.withColumnRenamed("item_id", "doc_id"), none)) == []


def test_no_table_row_holds_more_of_the_matrix_than_one_document(spark, monkeypatch):
    data = [(i, " ".join(f"w{i * 7 + j * j}" for j in range(200))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    matrix = importance.count_matrix(docs, buckets=50)
    assert matrix.count() == 60
    assert matrix.select(F.max(F.size("columns"))).first()[0] <= 50
    # Rows of several blocks of entries each, and one that is longer than a block.
    monkeypatch.setattr(importance, "BLOCK", 45)
    summed = {r.bucket: r.n for r in importance.column_sums(matrix, 50).collect()}
    assert summed == Counter(zlib.crc32(w.encode()) % 50 for _, text in data for w in text.split())
    weighed = rows(importance.weights(matrix, list(range(50))))
    assert weighed == sorted(((i, 200, 200, sum(zlib.crc32(w.encode()) % 50 for w in text.split())) for i, text in data), key=repr)


def test_ranks_have_no_gaps_between_ranges(spark):
    placed = importance.ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7), [F.desc("x")])
    assert rows(placed.select("rank", "x")) == sorted(((1000 - x, x) for x in range(1000)), key=repr)


# --- hard negatives


def plain_negatives(data, is_anchor, k=5, positives=5, least=80, most=100):
    def good(v):
        return v is not None and all(x is not None and abs(x) < float("inf") for x in v)

    ok = [(n, i, [math.floor(256 * x) for x in v], label) for n, (i, v, label) in enumerate(data) if label is not None and good(v)]
    first = lambda found: sorted(found, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))
    out = []
    for n, i, v, label in ok:
        if i is None or not is_anchor(i):
            continue
        scored = [(m, j, sum(x * y for x, y in zip(v, w)), other == label) for m, j, w, other in ok if m != n]
        for _, p, ps, _ in first([r for r in scored if r[3]])[:positives]:
            fit = first([r for r in scored if not r[3] and least * ps <= 100 * r[2] <= most * ps])[:k]
            out += [(i, p, rank, j, ps, ns) for rank, (_, j, ns, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def some_vectors(seed, width, count=400):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((6, width))
    data = [(int(i), (centers[i % 6] + 0.6 * r.standard_normal(width)).astype(np.float32).tolist(), int(r.integers(4))) for i in r.permutation(count)]
    data += [(5000, None, 1), (5010, [math.nan] * width, 1), (5020, data[0][1], None), (5030, [None] * width, 0), (5040, [math.inf] * width, 2), (5050, [0.0] * width, 0), (5060, [1.0], 1), (5070, [], 2)]
    data += [(None, data[3][1], 3), (5080, data[3][1], 2), (20, data[5][1], 1)]
    return data


@pytest.mark.parametrize("width", [2, 16])
def test_hard_negatives_equal_the_plain_version(spark, width, monkeypatch):
    data = some_vectors(width, width)
    frame = spark.createDataFrame(data, VECTORS).withColumn("anchor", F.lit("x")).withColumn("row", F.lit(1))
    want = plain_negatives(data, lambda i: i % 10 == 0)
    assert len(want) > 200
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    mine = lambda **more: rows(hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, **more).select(*columns))
    assert mine() == want
    monkeypatch.setattr(hard_negatives, "SHELL", 64 * width)
    monkeypatch.setattr(hard_negatives, "PART", 9)
    monkeypatch.setattr(hard_negatives, "LEAF", 3)
    assert mine() == want
    assert mine(k=2, positives=3, least=(95, 100), most=(110, 100)) == plain_negatives(data, lambda i: i % 10 == 0, 2, 3, 95, 110)


def test_hard_negatives_with_ties_and_hot_rows(spark, monkeypatch):
    # A third of the rows are one vector; many scores are equal, some zero and some negative.
    monkeypatch.setattr(hard_negatives, "SHELL", 60)
    monkeypatch.setattr(hard_negatives, "LEAF", 2)
    r = random.Random(5)
    data = [(i, [1.0, 0.0, 0.5] if i % 3 == 0 else [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)], i % 2 + i // 100) for i in range(150)]
    frame = spark.createDataFrame(data, VECTORS)
    assert rows(hard_negatives.mine(frame, F.col("vec_id") % 10 == 0)) == plain_negatives(data, lambda i: i % 10 == 0)


def test_hard_negatives_of_few_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert rows(hard_negatives.mine(empty, F.col("vec_id") == 0)) == []
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], VECTORS)
    assert rows(hard_negatives.mine(alone, F.col("vec_id") == 0)) == []
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e15], 1)], "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0)


def test_a_tree_opens_few_nodes_where_rows_lie_in_groups():
    r = np.random.default_rng(1)
    v = np.floor(256 * (10 * np.repeat(r.standard_normal((40, 8)), 100, axis=0) + 0.1 * r.standard_normal((4000, 8)))).astype(np.int64)
    squared = float((v.astype(float) ** 2).sum(axis=1).max())
    tree = hard_negatives.Tree(v, squared)
    scores = v @ v[0]
    low, high = int(np.sort(scores)[-50]), int(scores.max())
    opened = []

    class Places(list):
        def __getitem__(self, n):
            opened.append(n)
            return list.__getitem__(self, n)

    tree.places = Places(tree.places)
    got = tree.nearest(v[0], tree.to_vantages(v[:1])[0], np.ones(len(v), bool), [low], [high], 5)
    assert [p for _, p, _ in got] == sorted(range(len(v)), key=lambda i: (-scores[i], i))[:5]
    leaves = sum(v < 0 for v in tree.vantage)
    assert len(set(opened)) < leaves / 2


# --- fingerprints


def plain_syncmers(text, k, s):
    padded = "\0" * (k - s) + text + "\0" * (k - s)
    codes = lambda t: np.array([ord(c) for c in t], np.uint32)
    rank = lambda t: 2**64 if t == "\0" * s else int(syncmers._hashes(codes(t), s)[0])
    out = []
    for i in range(len(padded) - k + 1):
        inner = [rank(padded[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize(("k", "s"), [(24, 8), (9, 4), (5, 2)])
def test_syncmers_are_those_of_the_definition(k, s, monkeypatch):
    r = random.Random(k)
    texts = ["".join(r.choice("ab é語\U0001f600") for _ in range(n)) for n in (1, 2, 3, 5, 8, 17, 40, 200)] + ["a" * 60, "ab" * 30]
    for part in (syncmers.PART, 7):
        monkeypatch.setattr(syncmers, "PART", part)
        for text in texts:
            at, hashes = syncmers.anchors(text, k, s)
            assert at.tolist() == (plain_syncmers(text, k, s) or [0])
            got, same = syncmers.unpacked(syncmers.packed(at, hashes))
            assert got.tolist() == at.tolist() and same.tolist() == hashes.tolist()
            assert np.diff(at, prepend=0).max() <= max(k - s, 1)


def test_syncmers_know_nothing_of_what_stands_around():
    r = random.Random(6)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(99)) for _ in range(n))
    inside, one, other = words(60), words(30), words(7)
    a, b = (syncmers.anchors(x + inside + y) for x, y in ((one, other), (other, one)))
    within = lambda found, start: {(int(p) - start - 16, int(h)) for p, h in zip(*found) if start <= p - 16 <= start + len(inside) - 24}
    assert within(a, len(one)) == within(b, len(other)) and len(within(a, len(one))) > 30


def test_likeness_and_stretches(spark):
    r = random.Random(8)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b, c = words(200), words(200), words(200)
    pairs = [(a, a), (a, b), (a, a[:700] + b[700:]), (a, c + a), (a + b, b + a), ("", ""), ("", a), (None, None), (None, a), ("ab", "ab"), ("a", "b")]
    docs = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "id int, x string, y string").withColumn("text", F.lit(1))
    told = syncmers.with_fingerprints(docs, {"x": "f", "y": "g"})
    got = told.select("id", "f", "g", syncmers.likeness(F.col("f"), F.col("g")).alias("near"), syncmers.stretches(F.col("f"), F.col("g")).alias("s")).orderBy("id").collect()
    near = [g.near for g in got]
    assert near[0] == near[5] == near[7] == near[9] == 1.0 and near[6] == near[8] == near[10] == 0.0
    assert near[1] < 0.02 and abs(near[2] - 700 / len(a)) < 0.1 and abs(near[3] - 2 / 3) < 0.05 and abs(near[4] - 0.5) < 0.05
    beside = syncmers.with_fingerprints(docs, {"x": "f", "y": ""}, {"near": ("x", "y")}).orderBy("id").collect()
    assert [b.near for b in beside] == near and [b.f for b in beside] == [g.f for g in got] and len(beside[0]) == 4
    (one,) = [s for s in got[3].s if s.length > 100]
    assert one.other_start - one.start == len(c) and one.length > len(a) - 40
    for (x, y), g in zip(pairs, got):
        for s in g.s:
            if s.start >= 0 and s.other_start >= 0 and s.length > 30:
                assert x[s.start : s.start + min(s.length, len(x) - s.start)] == y[s.other_start : s.other_start + min(s.length, len(x) - s.start)]
    assert syncmers.share(None, "") is None


def test_neighbours_over_many_ranges(spark, monkeypatch):
    r = random.Random(9)
    data = [(i, "".join(r.choice("abc ") for _ in range(r.randrange(50)))) for i in r.sample(range(10**5), 300)] + [(4, None), (5, ""), (None, "last"), (7, "twice"), (7, "twice"), (7, "other")] + [(8, "same")] * 60
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("range", F.lit(2)).withColumn("n", F.lit(3)).repartition(6)
    hashes = {tuple(x)[:2]: x.h for x in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(data, key=lambda d: (d[0] is None, d[0] or 0, hashes[d]))
    want = sorted(((i, t, following) for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1])), key=repr)
    for size in (syncmers.RANGE, 400):
        monkeypatch.setattr(syncmers, "RANGE", size)
        out = syncmers.beside_next(docs)
        assert out.columns == ["doc_id", "text", "range", "n", "next_text"]
        assert rows(out.select("doc_id", "text", "next_text")) == want
    single = spark.createDataFrame([("only", "text")], "doc_id string, text string")
    assert rows(syncmers.beside_next(single)) == [("only", "text", "text")]
    assert rows(syncmers.beside_next(single.limit(0))) == []


def test_the_query_edits_the_second_half(spark, tmp_path):
    data = [(3, "éa" * 90), (1, "first text, and some more of it"), (2, None), (9, "x"), (5, "語" * 41)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t or "" for _, t in sorted(data)]
    got = queries.op13_syncmer_fingerprints(spark, str(tmp_path)).orderBy("doc_id").collect()
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    print_of = lambda t: syncmers.packed(*syncmers.anchors(t))
    for g, t, e, n in zip(got, texts, edited, texts[1:] + texts[:1]):
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), print_of(t), print_of(e))
        assert (g.near_edited, g.near_next) == (syncmers.share(print_of(t), print_of(e)), syncmers.share(print_of(t), print_of(n)))
