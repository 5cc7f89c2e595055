"""Resampling of documents towards a target distribution of hashed features.

The documents are a sparse matrix of counts: a row for each document, a column
for each bucket that features are hashed to. It is written once, as compressed
sparse rows (id, columns, counts), and worked on in blocks of them. Its column
sums are the distribution of the documents, those of the target's matrix the
distribution of the target; their log ratios are the gains, one a bucket; the
product of matrix and gains gives each document's weight. The documents are then
ordered by weight and noise, and the first ones are drawn.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, lean, slices, stored

#: Bytes of text, or entries, of one block of the matrix; a longer text is a block of its own.
BLOCK = 4_000_000
#: Words whose bucket a worker remembers at most, before it starts anew.
MEMO = 200_000
#: A row: its words, columns and counts of its entries. Readers and Arrow take some thousand table rows at once, however large, so that none holds more than one document.
CSR = "id {kind}, words bigint, columns array<int>, counts array<bigint>"


@cache
def _spaces() -> bytes:
    """A-Z become a-z, all other ASCII characters but 0-9 and a-z become spaces."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Runs of characters other than ASCII characters that are neither digits nor letters, A-Z lower-cased."""
    return raw.translate(_spaces()).split()


def features(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    runs = list(found)
    for n in range(2, longest + 1):
        runs += map(b" ".join, zip(*(found[i:] for i in range(n))))
    return runs


def count_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = 10000, longest: int = 1) -> DataFrame:
    """The documents by buckets of features, as compressed sparse rows.

    Each row of ``docs`` is one row of the matrix, a null or empty text one
    without entries; none has more entries than there are buckets.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    @lean
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        memo: dict[bytes, int] = {}

        def bucket(word: bytes) -> int:
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = at = zlib.crc32(word) % buckets
            return at

        for batch in batches:
            for some in slices(batch, "text", BLOCK):
                n_words, ends, columns, counts = [], [0], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
                for value in some.column("text"):
                    found = words(value.as_buffer().to_pybytes()) if value.is_valid else []
                    times = Counter(features(found, longest))
                    places = np.fromiter((memo[w] if w in memo else bucket(w) for w in times), np.int64, len(times))
                    own, place = np.unique(places, return_inverse=True)
                    columns.append(own.astype(np.int32))
                    counts.append(np.bincount(place, np.fromiter(times.values(), np.int64, len(times)), len(own)).astype(np.int64))
                    n_words.append(len(found))
                    ends.append(ends[-1] + len(own))
                each = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(n_words, pa.int64()), each(columns), each(counts)], names=["id", "words", "columns", "counts"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(build, CSR.format(kind=kind))


def column_sums(matrix: DataFrame, buckets: int = 10000) -> DataFrame:
    """(bucket, n) of the buckets that hold anything; each task passes on one row a bucket."""

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in slices(batch, "columns", BLOCK):
                columns, counts = (block.column(c).flatten().to_numpy() for c in ("columns", "counts"))
                total += np.bincount(columns, counts, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return matrix.select("columns", "counts").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10000, scale: int = 1000) -> list[int]:
    """floor(scale * log of the ratio of the target's share of a bucket to the source's), each with one feature more a bucket.

    ``buckets`` numbers, whatever the tables hold; they alone come to the driver.
    """
    import numpy as np

    counted = np.zeros((2, buckets), np.int64)
    for side, table in enumerate((source, target)):
        for row in table.collect():
            counted[side, row.bucket] = row.n
    s, t = counted.astype(float)
    of_source, of_target = (float(n + buckets) for n in counted.sum(axis=1))
    ratio = (t + 1) * of_source / ((s + 1) * of_target)
    return np.floor(scale * np.log(ratio)).astype(np.int64).tolist()


def weights(matrix: DataFrame, gain: list[int], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the product of the matrix and the gains, block by block; 0 for a row without entries."""
    kind = matrix.schema["id"].dataType.simpleString()

    @lean
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        each = np.array(gain, np.int64)
        for batch in batches:
            for block in slices(batch, "columns", BLOCK):
                columns, counts = (block.column(c).flatten().to_numpy() for c in ("columns", "counts"))
                ends = np.cumsum(pc.list_value_length(block.column("columns")).to_numpy())
                upto = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("words"), pa.array(upto(counts)), pa.array(upto(each[columns] * counts))], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(multiply, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("doc_id", doc_id)


def noise(doc_id: Column, seed: str = "2024", scale: int = 1000) -> Column:
    """floor(scale * Gumbel noise) by the first 32 bits of sha256 of ``seed:doc_id``; a null id counts as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order``, from 1, without one task for all: ranges are sorted one by one and the counts of those before are added.

    Only the counts, one a range, pass through one window.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("deltaloom_id", F.monotonically_increasing_id())
    placed = stored(placed.select("*", F.shiftright("deltaloom_id", 33).alias("deltaloom_range"), (F.col("deltaloom_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("deltaloom_at")).drop("deltaloom_id"), "ranked")
    counts = placed.groupBy("deltaloom_range").agg(F.count("*").alias("deltaloom_n"))
    before = F.coalesce(F.sum("deltaloom_n").over(Window.orderBy("deltaloom_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("deltaloom_range", before.alias("deltaloom_before"))
    return placed.join(F.broadcast(starts), "deltaloom_range").withColumn(name, F.col("deltaloom_before") + F.col("deltaloom_at") + 1).drop("deltaloom_range", "deltaloom_before", "deltaloom_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10000, longest: int = 1, seed: str = "2024", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of ``docs``.

    n_features: runs of 1 to ``longest`` words, repeats counted. weight: sum of
    their buckets' gains, 0 without features. score: weight with Gumbel noise
    that hangs on the id alone. Of the N rows with at least ``least_words``
    words the floor(percent * N / 100) highest scores are drawn, ties to the
    smaller id (null last), then to fewer features; rank is their place from 1,
    null for rows not drawn. Counts take in every row of both tables, null and
    empty texts as none. Repeated rows are each drawn for themselves. Without
    target, or with an empty one, gains come from the documents alone.

    Two scans: one builds the matrix of the documents, one that of the target;
    the sums and the product read the matrix. No text is shuffled.
    """
    matrix = stored(count_matrix(docs, doc_id, text, buckets, longest), "matrix")
    gain = gains(column_sums(matrix, buckets), column_sums(count_matrix(target, target.columns[0], text, buckets, longest), buckets), buckets)
    scored = weights(matrix, gain, doc_id).withColumn("score", F.col("weight") + noise(F.col(doc_id), seed)).withColumn("drawable", F.col("n_words") >= least_words)
    order = [F.desc("drawable"), F.desc("score"), F.col(doc_id).asc_nulls_last(), F.asc("n_features")]
    placed = ranked(scored, order, "place")
    drawn = percent * placed.filter("drawable").count() // 100
    dropped(matrix)
    return placed.select(doc_id, "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
