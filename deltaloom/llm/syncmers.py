"""Fingerprints of documents from closed syncmers.

A text is cut into all its substrings of ``k`` characters. One of them is a
closed syncmer if, of its own substrings of ``s`` characters, the least by hash
is the first or the last one. That hangs on these k characters alone, so equal
passages have the same syncmers whatever stands around them, and no stretch of
k - s characters is without the start of one. The fingerprint is the list of all
syncmers in the order of the text, each with 24 bits of its hash and the
distance from the one before; two fingerprints are compared by the syncmers that
they have in the same order.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, lean, slices, spread, stored

#: Characters hashed at once, and bytes of text of one step.
PART, STEP = 1 << 17, 2_000_000
#: Bytes of text that one range of neighbours holds on average.
RANGE = 32 << 20


def _mixed(x):
    """A 64-bit mix of unsigned 64-bit integers (numpy arrays wrap round)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(codes, length: int):
    """Of every run of ``length`` codes, by halves: runs of 1, 2, 4, … are joined, the rest overlaps."""
    import numpy as np

    h, have = _mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    while have < length:
        step = min(have, length - have)
        h = _mixed(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:])
        have += step
    return h


def _least(values, width: int):
    """The least of every ``width`` neighbours."""
    import numpy as np

    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def closed(codes, k: int, s: int):
    """(places, hashes) of the closed syncmers among the runs of ``k`` codes; a run of ``s`` zeros is never the least of one."""
    import numpy as np

    if len(codes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    plain, empty = _hashes(codes, s), _hashes(np.zeros(s, np.uint32), s)[0]
    inner = np.where(plain == empty, np.uint64(2**64 - 1), plain)
    least = _least(inner, k - s + 1)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    h = plain[at]
    for start in [*range(s, k - s, s), k - s]:
        h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + plain[at + start])
    return at, h


def anchors(text: str, k: int = 24, s: int = 8):
    """(start, 24-bit hash) of a text's closed syncmers, by start.

    The text's ends are marked: k - s empty characters stand before and after
    it, and starts count from the first of them. A text too short to have a
    syncmer is one as a whole; an empty one has none.
    """
    import numpy as np

    if not text:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([np.zeros(k - s, np.uint32), codes, np.zeros(k - s, np.uint32)])
    found = [(at + start, h) for start in range(0, len(codes) - k + 1, PART) for at, h in [closed(codes[start : start + PART + k - 1], k, s)]]
    at = np.concatenate([a for a, _ in found]) if found else np.empty(0, np.int64)
    if not len(at):
        return np.zeros(1, np.int64), (_hashes(codes, len(codes)) >> np.uint64(40)).astype(np.uint32)
    return at, (np.concatenate([h for _, h in found]) >> np.uint64(40)).astype(np.uint32)


def packed(at, hashes) -> str:
    """A fingerprint: 4 bytes a syncmer in base64, three of the hash and one of the distance from the syncmer before."""
    import numpy as np

    gaps = np.diff(at, prepend=0).astype(np.uint32)
    return base64.b64encode((hashes << np.uint32(8) | gaps).astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str):
    """(start, hash) of the syncmers of a fingerprint."""
    import numpy as np

    raw = np.frombuffer(base64.b64decode(fingerprint), "<u4")
    return np.cumsum(raw & 255), raw >> 8


def _named(hashes):
    """Each hash with how many equal ones stand before it."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    run = np.flatnonzero(np.diff(hashes[order], prepend=-1))
    nth = np.empty(len(hashes), np.int64)
    nth[order] = np.arange(len(hashes)) - np.repeat(run, np.diff(np.append(run, len(hashes))))
    return hashes.astype(np.int64) | nth << 24


def in_order(a, b):
    """Places in ``a`` and ``b`` (hashes) of the syncmers they have in one order: the n-th of a kind meets the n-th, and of these the longest rising chain counts."""
    import numpy as np

    if len(a) == len(b) and (a == b).all():
        return np.arange(len(a)), np.arange(len(a))
    _, left, right = np.intersect1d(_named(a), _named(b), assume_unique=True, return_indices=True)
    by = np.argsort(left)
    left, right = left[by], right[by]
    if (np.diff(right) > 0).all():
        return left, right
    ends: list[int] = []  # of chains of each length, the least end
    last: list[int] = []
    before = np.full(len(right), -1)
    for i, value in enumerate(right.tolist()):
        length = bisect_left(ends, value)
        before[i] = last[length - 1] if length else -1
        ends[length : length + 1], last[length : length + 1] = [value], [i]
    chain = [last[-1]]
    while before[chain[-1]] >= 0:
        chain.append(int(before[chain[-1]]))
    return left[chain[::-1]], right[chain[::-1]]


def shared(a, b) -> float:
    """Twice the syncmers (hashes) in one order by the syncmers of both; 1 if both are empty."""
    return 2 * len(in_order(a, b)[0]) / (len(a) + len(b)) if len(a) and len(b) else float(len(a) == len(b))


def share(a: str | None, b: str | None) -> float | None:
    """What two fingerprints have ``shared``; null if one is null."""
    return None if a is None or b is None else shared(unpacked(a)[1], unpacked(b)[1])


def likeness(a: Column, b: Column) -> Column:
    """Of two columns of fingerprints, from 0 to 1; equal ones have 1, null where either is null."""

    @F.pandas_udf("double")
    def compared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([share(x, y) for x, y in zip(left, right)], dtype="float64")

    return compared(a, b)


def stretches(a: Column, b: Column, k: int = 24, s: int = 8) -> Column:
    """Where two fingerprints agree: an array of (start, other_start, length) in characters, in order.

    Syncmers in one order whose distances are equal on both sides are one
    stretch; starts may be up to k - s below 0, where ends are marked.
    """

    def runs(x: str, y: str) -> list[dict[str, int]]:
        import numpy as np

        (at, left), (other, right) = unpacked(x), unpacked(y)
        i, j = in_order(left, right)
        shift, start = at[i].astype(int) - other[j], at[i].astype(int) - (k - s)
        first = np.flatnonzero((np.diff(shift, prepend=-(2**40)) != 0) | (np.diff(start, prepend=-(2**40)) > k))
        last = np.append(first[1:], len(i)) - 1
        return [{"start": int(start[f]), "other_start": int(start[f] - shift[f]), "length": int(start[e] - start[f] + k)} for f, e in zip(first, last)]

    @F.pandas_udf("array<struct<start:int,other_start:int,length:int>>")
    def compared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else runs(x, y) for x, y in zip(left, right)])

    return compared(a, b)


def with_fingerprints(rows: DataFrame, names: dict[str, str], near: dict[str, tuple[str, str]] | None = None, k: int = 24, s: int = 8) -> DataFrame:
    """``rows`` with the fingerprints of text columns in place of them: names gives the new name of each.

    near: by name of a further column the two text columns whose likeness it
    holds, as ``likeness`` has it for their fingerprints. An empty new name
    leaves that fingerprint out. All characters of all texts are read; a null
    text counts as an empty one, whose fingerprint is empty. Texts are taken
    2 MB at a time and hashed in parts of 131,072 characters, which changes no
    syncmer, as these know nothing of what stands around them. No shuffle.
    """
    near, kept = near or {}, [c for c in rows.columns if c not in names]
    told = {c: n for c, n in names.items() if n}
    schema = rows.select(*kept, *(F.lit("").alias(n) for n in told.values()), *(F.lit(0.0).alias(n) for n in near)).schema

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter(names))
        for batch in batches:
            for some in slices(batch, first, STEP):
                prints: dict[str, list[str]] = {c: [] for c in told}
                shares: dict[str, list[float]] = {n: [] for n in near}
                for i in range(some.num_rows):
                    found = {c: anchors(some.column(c)[i].as_py() or "", k, s) for c in names}
                    for c in told:
                        prints[c].append(packed(*found[c]))
                    for n, (a, b) in near.items():
                        shares[n].append(shared(found[a][1], found[b][1]))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *(pa.array(v, pa.string()) for v in prints.values()), *(pa.array(v, pa.float64()) for v in shares.values())], names=schema.names)

    return rows.select(*kept, *names).mapInArrow(add, schema)


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "next_text") -> DataFrame:
    """``docs`` with the text of the next document in the order of doc_id (null last); the last one has the first one's.

    Rows of one doc_id are in the order of a hash of their text, then of their
    place in the files. A single document is its own next one, an empty table
    gives no rows. Null texts stay null.

    Keys (id, hash, place) are range-partitioned without their texts; the first
    key of each range, one for some 32 MB of text, is a bound. Then each text
    goes once to its range, the first one of a range to the range before, too,
    and ``lead`` looks one row ahead within the range.
    """
    keyed = docs.withColumn("deltaloom_key", F.struct(F.col(doc_id).isNull().alias("without"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row")))
    key = F.col("deltaloom_key")
    keys = stored(keyed.select("deltaloom_key", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")), "keys")
    ranges = max(1, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // RANGE))
    firsts = keys.select(key).repartitionByRange(ranges, "deltaloom_key").groupBy(F.spark_partition_id()).agg(F.min("deltaloom_key").alias("key"))
    bounds = [r.key for r in firsts.orderBy("key").select(F.to_json("key").alias("key")).collect()]
    dropped(keys)
    n = max(1, len(bounds))
    bound = lambda i: F.get(F.from_json(F.lit(f"[{','.join(bounds)}]"), f"array<{keyed.schema['deltaloom_key'].dataType.simpleString()}>"), i)
    # The last bound that is not above the key, by halving steps.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < n) & (bound(at + step) <= key), at + step).otherwise(at))
    own = keyed.withColumn("deltaloom_own", place)
    to = lambda at, beyond: F.struct(at.cast("int").alias("deltaloom_range"), F.lit(beyond).alias("deltaloom_beyond"))
    here, before = to(F.col("deltaloom_own"), False), to((F.col("deltaloom_own") + (n - 1)) % n, True)
    sent = own.select(*docs.columns, "deltaloom_key", F.inline(F.when(bound(F.col("deltaloom_own")) == key, F.array(here, before)).otherwise(F.array(here))))
    order = Window.partitionBy("deltaloom_range").orderBy("deltaloom_beyond", "deltaloom_key")
    beside = spread(sent, n, "deltaloom_range").withColumn(name, F.lead(text).over(order)).filter("not deltaloom_beyond")
    return beside.select(*docs.columns, name)
