"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents are sets of word shingles. Bands of a MinHash signature name
candidate pairs; a pair's signatures are then compared batch by batch, and the
pair is given up as soon as the posterior probability that its similarity
reaches the threshold falls below a chosen miss probability. Pairs that survive
are verified on their full sets.

Documents of the same words in the same order are one class and are compared
once. In a band's bucket each class is first compared with one leader, not with
all others, so that a large group of copies costs a number of comparisons near
its size. What is left are buckets with classes of different components; those
are paired by an exact rule on their rarest shingles, so that no link between
components is lost and a passage that many documents share does not pair them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, components, dropped, lean, slices, stored

#: Words kept with their hash during a task; emptied when full.
MEMO_WORDS = 100_000
#: Bytes of text taken from a batch at once.
TOGETHER = 4 << 20
#: Hashes of a signature compared before the posterior is looked at again.
BATCH = 16


class _Hashes(dict):
    """64-bit hash by word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = _Hashes()


def _forgetful(function):
    """``lean``, and the words of the task are forgotten at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _hashes.clear()

    return lean(run)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased. bytes.split() cuts at the six ASCII white-space bytes, bytes.lower() changes A-Z alone."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], length: int):
    """Sorted distinct 64-bit hashes of the runs of ``length`` words; of the whole sequence if it is shorter; none without words."""
    import numpy as np

    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(length, len(w))
    mixed = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


@cache
def _multipliers(hashes: int):
    import numpy as np

    rng = np.random.default_rng(5)
    return rng.integers(0, 2**64, hashes, np.uint64) | np.uint64(1), rng.integers(0, 2**64, hashes, np.uint64)


def signature(shingles, hashes: int):
    """The upper 32 bits of the least value of ``hashes`` random linear maps of the shingles."""
    import numpy as np

    a, b = (x[:, None] for x in _multipliers(hashes))
    out = np.full(hashes, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 256):  # small enough to stay in a core's cache
        values = a * shingles[at : at + 256]
        values += b
        np.minimum(out, values.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


@cache
def least_matches(hashes: int, threshold: float, miss: float) -> tuple[int, ...]:
    """After 16, 32, ... compared bytes of the signatures, the matches below which a pair is given up.

    One byte of two signatures agrees with probability c = s + (1 - s) / 256 at
    similarity s. With a uniform prior the posterior of c after m matches in n
    is Beta(m + 1, n - m + 1), and P(c >= t) = P(Binomial(n + 1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _signed(docs: DataFrame, doc_id: str, text: str, length: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, class, n_shingles, bands, signature): class null and both arrays empty without words."""
    hashes = bands * rows

    @_forgetful
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        import xxhash

        for batch in (some for batch in batches for some in slices(batch, "text", TOGETHER)):
            names, sizes, keys, signs = [], [], [], []
            for value in batch.column("text"):
                words = words_of(value.as_py())
                shingles = shingle_hashes(words, length)
                sizes.append(len(shingles))
                if not words:
                    names.append(None)
                    keys.append([])
                    signs.append([])
                    continue
                names.append(blake2b(b" ".join(words), digest_size=16).digest())
                s = signature(shingles, hashes)
                keys.append([xxhash.xxh3_64_intdigest(s[i * rows : (i + 1) * rows].tobytes(), seed=i) - 2**63 for i in range(bands)])
                signs.append((s & 255).astype("u1").view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "class", "n_shingles", "bands", "signature"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(sign, f"doc_id {kind}, text_hash long, class binary, n_shingles long, bands array<long>, signature array<long>")


def _agreeing(p: str, q: str, limits: tuple[int, ...]) -> Column:
    """Whether no batch of two signatures (arrays of eight bytes each) rules the pair out."""
    batches = []
    for batch, least in enumerate(limits, 1):
        differ = F.lit(0)
        for i in range((batch - 1) * BATCH // 8, batch * BATCH // 8):
            x = F.get(F.col(p), F.lit(i)).bitwiseXOR(F.get(F.col(q), F.lit(i)))
            for shift in (4, 2, 1):  # the lowest bit of each byte tells whether any of it is set
                x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        batches.append(F.struct(differ.alias("differ"), F.lit(batch * BATCH - least).alias("most")))
    start = F.struct(F.lit(0).alias("differ"), F.lit(True).alias("open"))
    step = lambda s, x: F.struct((s["differ"] + x["differ"]).alias("differ"), (s["open"] & (s["differ"] + x["differ"] <= x["most"])).alias("open"))
    return F.aggregate(F.array(*batches), start, step, lambda s: s["open"])


def _promising(pairs: DataFrame, signs: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures rules out."""
    two = pairs.join(signs.select(F.col("class").alias("a"), F.col("signature").alias("p")), "a").join(signs.select(F.col("class").alias("b"), F.col("signature").alias("q")), "b")
    return two.filter(_agreeing("p", "q", limits)).select("a", "b")


def _texts(named: DataFrame, docs: DataFrame, signs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(class, text) for each class of ``named``."""
    wanted = named.select("class").distinct().join(signs.select("class", "least_id"), "class")
    source = docs.select(F.col(doc_id).alias("least_id"), F.col(text).alias("text"))
    held = source.join(wanted, source["least_id"].eqNullSafe(wanted["least_id"])).select("class", "text")

    @lean
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows that share a doc_id may have other words than the class asked for.
        from hashlib import blake2b

        for batch in (some for batch in batches for some in slices(batch, "text", TOGETHER)):
            keep = [blake2b(b" ".join(words_of(t)), digest_size=16).digest() == c for t, c in zip(batch.column("text").to_pylist(), batch.column("class").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return stored(held.mapInArrow(own, "class binary, text string").dropDuplicates(["class"]), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, length: int, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of classes whose sets, of the texts themselves, have intersection / union >= share."""
    two = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("q")), "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias("p")), "a")
    # The same leader in a row of pairs: its set is made once.
    two = two.select("a", "b", "p", "q").sortWithinPartitions("a")

    @_forgetful
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last, left = None, None
        for batch in (some for batch in batches for some in slices(batch, "q", TOGETHER)):
            keep = []
            for a, p, q in zip(*(batch.column(c) for c in ("a", "p", "q"))):  # one text at a time is copied
                if (a := a.as_py()) != last:
                    last, left = a, shingle_hashes(words_of(p.as_py()), length)
                right = shingle_hashes(words_of(q.as_py()), length)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both * share[1] >= share[0] * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.mapInArrow(check, "a binary, b binary")


def _fitting(share: tuple[int, int], a: str, b: str) -> Column:
    """Whether sets of the sizes in columns ``a`` and ``b`` can reach the share."""
    return F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]


def _by_prefix(rest: DataFrame, texts: DataFrame, length: int, share: tuple[int, int]) -> DataFrame:
    """Pairs of classes in different components that can reach the share: an exact way that needs no pairs of all.

    With each set's shingles in the order of how many sets have them, two sets
    that reach the share have a shingle in common among the first
    size - ceil(share * size) + 1 of either, and from the first such shingle on
    both have enough left for the intersection they need. What very many sets
    have comes last, so a passage that they share does not pair them unless it is
    most of them.
    """

    @_forgetful
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for name, value in zip(batch.column("class"), batch.column("text")):
                shingles = shingle_hashes(words_of(value.as_py()), length)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(shingles), pa.binary()), pa.array(shingles.view(np.int64))], names=["class", "shingle"])

    every = stored(texts.mapInArrow(split, "class binary, shingle long"), "shingles")
    often = every.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1")
    # Shingles of one set alone come first in its order and pair it with none.
    of_class = every.join(often, "shingle").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("shared"))
    told = of_class.join(rest, "class").withColumn("alone", F.col("size") - F.size("shared"))
    first = F.col("size") - F.ceil(F.col("size") * share[0] / F.lit(share[1])) + 1 - F.col("alone")
    prefix = told.filter(first > 0).select("class", "component", "size", "alone", F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))["shingle"]).alias("at", "shingle"))
    prefix = stored(prefix.withColumn("left", F.col("size") - F.col("alone") - F.col("at")).drop("alone", "at"), "prefix")
    x, y = (prefix.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "component", "size", "left"))) for s in "xy")
    enough = F.least("left_x", "left_y") * (share[0] + share[1]) >= (F.col("size_x") + F.col("size_y")) * share[0]
    met = x.join(y, "shingle").filter((F.col("component_x") < F.col("component_y")) & enough)
    return met.select(F.col("class_x").alias("leader"), F.col("class_y").alias("other"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 5, share: tuple[int, int] = (75, 100), bands: int = 32, rows: int = 4, miss: float = 1e-5, leaders: int = 2) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id), one row for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a
    document's set is its distinct runs of ``length`` words, or its whole word
    sequence if that is shorter. Documents whose sets have intersection /
    union >= share are linked. component_id is the smallest doc_id reachable,
    component names the group. Documents without words (null, empty, white
    space) link with nothing and have no component. Null ids count only where a component has no other;
    repeated rows of one doc_id each belong to the component of their own
    text. An empty table gives an empty result. Sets are of 64-bit hashes of
    shingles, classes are known by 128-bit hashes of their words.

    At a similarity equal to the threshold a pair shares no band with
    probability (1 - 0.75 ** rows) ** bands, 5e-6 as set, and less above it.
    ``leaders`` rounds compare each class of a bucket with one leader of the
    bucket's largest component; then the classes of buckets that still hold
    several components are paired by the rarest of their shingles.
    """
    signed = stored(_signed(docs, doc_id, text, length, bands, rows), "signed")
    # One row for each class, of which copies know nothing.
    signs = stored(signed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("least_size"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    limits = least_matches(bands * rows, share[0] / share[1], miss)
    spread = signs.select("class", F.col("least_size").alias("size"), F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first <> last")
    buckets = stored(spread.join(shared.select("bucket"), "bucket"), "buckets")
    edges, found_groups = None, None
    for turn in range(leaders + 1):
        labelled = buckets.withColumn("component", F.col("class"))
        if found_groups is not None:
            labelled = buckets.join(found_groups.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        # Only buckets with classes of more than one component can still add a link that matters.
        # A leader is of the bucket's largest component: first the same one in all its buckets, then another in each.
        choice = F.xxhash64("bucket", "class", F.lit(turn)) if turn else F.col("class")
        parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("many"), F.min_by(F.struct("class", "size"), choice).alias("leader"))
        mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by(F.struct("component", "leader"), F.struct("many", "component")).alias("main")).filter("parts > 1")
        mixed = mixed.select("bucket", F.col("main.component").alias("main"), F.col("main.leader.class").alias("leader"), F.col("main.leader.size").alias("leader_size"))
        met = labelled.join(mixed, "bucket")
        if turn < leaders:
            pairs = met.filter((F.col("component") != F.col("main")) & _fitting(share, "size", "leader_size")).select("leader", F.col("class").alias("other"))
        else:
            rest = stored(met.select("class", "component", "size").distinct(), "rest")
            rest_texts = _texts(rest, docs, signs, doc_id, text)
            pairs = _by_prefix(rest, rest_texts, length, share)
        pairs = stored(pairs.select(F.least("leader", "other").alias("a"), F.greatest("leader", "other").alias("b")).distinct(), "pairs")
        survivors = stored(_promising(pairs, signs, limits), "survivors")
        ends = survivors.select(F.col("a").alias("class")).unionByName(survivors.select(F.col("b").alias("class")))
        texts = _texts(ends, docs, signs, doc_id, text) if turn < leaders else rest_texts
        found = stored(_verified(survivors, texts, length, share), "verified")
        for done in (pairs, survivors, texts):
            dropped(done)
        edges = found if edges is None else edges.unionByName(found)
        found_groups = stored(components(edges), "components")
    classes = signs.select("class", "least_id")
    if found_groups is not None:
        classes = classes.join(found_groups.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        classes = classes.join(classes.groupBy("component").agg(F.min("least_id").alias("component_id")), "component")
    else:
        classes = classes.withColumn("component", F.col("class")).withColumn("component_id", F.col("least_id"))
    out = signed.select("doc_id", "text_hash", "class", "n_shingles").join(classes.select("class", "component", "component_id"), "class", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``groups``; kept: doc_id equals component_id."""
    return groups(docs, doc_id, text, **settings).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group the one of the smallest doc_id (null last), and every document without words.

    Of rows of that doc_id in the group with several texts, the one of the
    least text hash stays; of rows alike in all columns, one.
    """
    found = groups(docs, doc_id, text, **settings).filter("component is not null")
    rows = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "times")).alias("kept"))
    first = stored(first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"), F.col("kept.times").alias("times")), "kept")
    worded = docs.filter(F.coalesce(F.col(text).rlike(WORD), F.lit(False)))
    mine = worded[doc_id].eqNullSafe(F.col("kept_id")) & (F.xxhash64(worded[text]) == F.col("kept_hash"))
    once = worded.join(first.filter("times = 1"), mine, "left_semi")
    # Only what is repeated is shuffled again.
    again = worded.join(first.filter("times > 1"), mine, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(again).unionByName(docs.filter(~F.coalesce(F.col(text).rlike(WORD), F.lit(False))))
