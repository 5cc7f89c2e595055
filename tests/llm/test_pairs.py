"""Near-duplicate documents and vectors, repeated strings, and searches against plain versions."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import common, minhash, sphere_caps, suffix_dedup, topk


def rows(df):
    return {tuple(r) for r in df.collect()}


def changed(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def some_documents(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n\t ", "One", "one", "one two\x0bthree four", "ONE two three four", "É one two three four five", "é one two three four five"]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 40, 200]))]
        for _ in range(r.randrange(1, 14)):
            texts.append(" ".join(changed(r, base, r.choice([0, 0, 1, 2, 3, 5]))))
    texts.append(" ".join(r.choice(vocabulary) for _ in range(30000)))
    texts.append(texts[-1] + " more")
    ids = r.sample(range(10**6), len(texts))
    return list(zip(ids, texts))


def test_near_documents_equal_the_plain_version(spark):
    data = some_documents()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("component", F.lit(1))
    assert rows(minhash.near_duplicates(docs)) == brute.near_documents(data)


def test_a_bucket_of_unlinked_documents_loses_no_link(spark):
    # All share a long passage, so they meet in many bands, but only neighbours in the chain are linked.
    r = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    data = [(i, " ".join(base[: 100 - 6 * (i % 12)] + [f"x{i % 12}_{j}" for j in range(6 * (i % 12))])) for i in range(36)]
    r.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(minhash.near_duplicates(docs, leaders=1)) == brute.near_documents(data)


def test_near_documents_edges(spark):
    schema = "doc_id long, text string"
    assert rows(minhash.near_duplicates(spark.createDataFrame([], schema))) == set()
    data = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words"), (None, "A b c d e f"), (None, None), (7, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(data, schema)).collect()), key=repr)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (5, 1, 5, True), (None, 2, 5, False), (None, 0, None, True), (7, 0, 7, True)], key=repr)


def test_pairs_are_given_up_only_below_the_miss_probability():
    limits = minhash.least_matches(128, 0.75, 1e-6)
    rng = np.random.default_rng(0)
    agree = rng.random((20000, 128)) < 0.75
    counts = agree.reshape(20000, -1, 16).sum(axis=2).cumsum(axis=1)
    assert (counts >= np.array(limits)).all(axis=1).mean() > 0.999
    agree = rng.random((2000, 128)) < 0.4
    counts = agree.reshape(2000, -1, 16).sum(axis=2).cumsum(axis=1)
    assert (counts >= np.array(limits)).all(axis=1).mean() < 0.01


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert rows(common.components(edges)) == {(i, 0) for i in range(301)}


def some_vectors(seed=2):
    r = np.random.default_rng(seed)
    out = []
    for group in range(30):
        center = r.standard_normal(64)
        for _ in range(r.integers(1, 15)):
            out.append((center + r.choice([0, 0.05, 0.1, 0.14]) * r.standard_normal(64) * np.linalg.norm(center) / 8).astype(np.float32).tolist())
    data = [(i, v, int(i % 3)) for i, v in enumerate(out)]
    data += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [math.nan] * 64, 1), (1003, out[0], None), (1004, [1.0, 0.0], 0), (1005, [2.0, 0.0], 0), (1006, [math.inf] * 64, 2), (1007, [None] + out[0][1:], 0), (1008, out[3], 0), (1009, [], 0)]
    return data


VECTORS = "vec_id long, embedding array<float>, label int"


def test_near_vectors_equal_the_plain_version(spark):
    data = some_vectors()
    got = rows(sphere_caps.near_duplicates(spark.createDataFrame(data, VECTORS).withColumn("class", F.lit(1))))
    assert got == brute.near_vectors(data)
    assert rows(sphere_caps.near_duplicates(spark.createDataFrame([], VECTORS))) == set()


def test_blocks_of_a_large_filter(spark, monkeypatch):
    monkeypatch.setattr(sphere_caps, "BLOCK", 4)
    data = some_vectors(7)
    assert rows(sphere_caps.near_duplicates(spark.createDataFrame(data, VECTORS))) == brute.near_vectors(data)


def test_repeated_vectors(spark):
    data = [(4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]
    got = sorted(map(tuple, sphere_caps.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()), key=repr)
    assert got == sorted([(4, 3, 4, True), (4, 3, 4, True), (9, 3, 4, False), (None, 3, 4, False)], key=repr)


def test_filters_share_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    u = r.standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = r.standard_normal((4000, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.98 * u + math.sqrt(1 - 0.98**2) * w
    shared = set()
    for c in range(16):
        code, threshold = sphere_caps.product_code(64, 2, 32, 3.0, c)
        a, b = (set(zip(*map(np.ndarray.tolist, sphere_caps.list_decode(x, code, threshold)))) for x in (u, v))
        shared |= {i for i, _ in a & b}
    assert len(shared) / 4000 > 0.998
    whole = np.nonzero((u[:50] @ code[0].T)[:, :, None] + (u[:50] @ code[1].T)[:, None, :] >= threshold)
    assert {(i, x * 32 + y) for i, x, y in zip(*map(np.ndarray.tolist, whole))} == {p for p in a if p[0] < 50}


def some_texts(seed=5):
    r = random.Random(seed)
    letters = "abcdefghijklmnop é"
    passage = ["".join(r.choice(letters) for _ in range(r.choice([90, 130, 260]))) for _ in range(6)]
    texts = [None, "", "x" * 700, "ab" * 90, "short"]
    for _ in range(60):
        parts = ["".join(r.choice(letters) for _ in range(r.randrange(150))) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(passage)[r.randrange(12) :])
        texts.append("".join(parts))
    texts += texts[10:20]
    texts.append("".join(texts[20:40]))
    r.shuffle(texts)
    return list(zip(r.sample(range(10**6), len(texts)), texts))


def removed(spark, data):
    out = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").withColumn("group", F.lit(3)))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("sha"))


def test_repeated_strings_equal_the_plain_version(spark):
    data = some_texts()
    assert rows(removed(spark, data)) == brute.repeats(data)


def test_repeated_strings_over_many_groups_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1500)
    data = some_texts(6)
    assert rows(removed(spark, data)) == brute.repeats(data)


def test_a_text_of_several_parts_is_judged_whole(spark):
    r = random.Random(12)
    some = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    long = some(suffix_dedup.PART + 60_000)
    edge = long[suffix_dedup.PART - 700 : suffix_dedup.PART + 900]  # lies over the edge of two parts
    data = [(5, long), (6, some(300) + edge + some(50)), (2, some(90) + long[1000:1100]), (7, edge + some(suffix_dedup.PART) + edge[:99] + some(9) + edge[40:])]
    assert rows(removed(spark, data)) == brute.repeats(data)


def test_a_line_of_very_many_documents_fills_no_group(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 8, raising=False)
    plain = suffix_dedup.equal_windows

    def bounded(raw, *rest):
        assert len(raw) < 6000
        return plain(raw, *rest)

    monkeypatch.setattr(suffix_dedup, "equal_windows", bounded)
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghijklmnop é") for _ in range(n))
    line, tails = some(60), [some(50) for _ in range(5)]
    data = [(i, some(120) + line + r.choice([*tails, some(50)]) + some(60)) for i in r.sample(range(10**6), 200)]
    data += [(10**6 + i, text) for i, (_, text) in enumerate(some_texts(7))]
    assert rows(removed(spark, data)) == brute.repeats(data)


def test_repeated_strings_edges(spark):
    assert rows(removed(spark, [])) == set()
    text = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz" * 5
    got = sorted((r.doc_id or -1, r.n_removed) for r in removed(spark, [(3, text), (3, text), (None, text), (8, text[5:])]).collect())
    own = next(iter(brute.repeats([(1, text)])))[2]
    assert got == [(-1, len(text)), (3, own), (3, own), (8, len(text) - 5)]


def test_suffix_array_classes():
    r = random.Random(1)
    for _ in range(20):
        base = bytes(r.choice(b"abcd") for _ in range(300))
        parts = [base[(i := r.randrange(200)) : i + r.randrange(50, 100)] for _ in range(9)]
        sizes = np.array([len(p) for p in parts])
        names = suffix_dedup.equal_windows(np.frombuffer(b"".join(parts), np.uint8), sizes, sizes - 49, 50)
        windows = [p[i : i + 50] for p in parts for i in range(len(p) - 49)]
        assert len(set(zip(windows, names))) == len(set(windows)) == len(set(names.tolist()))


def plain_search(data, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in data if v is not None and all(x is not None and abs(x) < math.inf for x in v)]
    out = set()
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_search_equals_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 100)
    r = np.random.default_rng(1)
    data = [(i, (r.standard_normal(16) / 4).astype(np.float32).tolist()) for i in range(500)]
    data += [(i + 500, data[i][1]) for i in range(0, 200, 3)]
    data += [(1000, None), (1050, [math.nan] * 16), (1100, [0.5, None] + [0.0] * 14), (1150, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("row", F.lit(0))
    assert rows(topk.search(df, F.col("vec_id") % 50 == 0)) == plain_search(data)
    small = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert rows(topk.search(small, F.col("vec_id") % 50 == 0)) == {(0, 1, 3, 256 * 512)}
    assert rows(topk.search(small.limit(0), F.col("vec_id") % 50 == 0)) == set()


def test_scores_beyond_64_bits_are_refused(spark):
    big = spark.createDataFrame([(0, [2e7] * 4), (1, [1.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.search(big, F.col("vec_id") % 50 == 0)
    fine = spark.createDataFrame([(0, [4e6] * 4), (1, [4e6] * 4), (1, [4e6] * 4)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(fine, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, n, 1, 4 * (256 * 4000000) ** 2) for n in (1, 2)]


@pytest.mark.parametrize("width", [1, 2, 8, 24, 300])
def test_near_vectors_of_any_width(spark, width):
    r = np.random.default_rng(width)
    centres = [r.standard_normal(width) for _ in range(6)]
    near = lambda c: c + 0.14 * r.standard_normal(width) * np.linalg.norm(c) / width**0.5
    data = [(i, near(centres[i % 6]).astype(np.float32).tolist(), 0) for i in range(60)]
    assert rows(sphere_caps.near_duplicates(spark.createDataFrame(data, VECTORS))) == brute.near_vectors(data)
