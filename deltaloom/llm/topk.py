"""Exact top-k inner products by block-at-a-time pruning.

Candidates lie in ranges of ids, each cut into blocks. A block keeps the
greatest and least value of each component, so that for a query the sum of the
greatest products bounds every score in it. A query takes the blocks in the
order of their bounds and scores a block's vectors directly, until the next
bound is below the k-th score found.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, stored

#: Candidates of one range and queries of one part; a task holds one of each. Candidates of a block.
RANGE, PART, BLOCK = 16384, 4096, 64


def is_vector(v: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def matrix(column: pa.ChunkedArray, width: int):
    """Lists of numbers as rows, shorter ones filled with zeros."""
    import numpy as np

    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def block_search(queries, query_rows, vectors, vector_rows, k: int):
    """(query place, candidate place, score) of each query's k best, ties to the smaller id (arrays sorted by id)."""
    import numpy as np

    if float(abs(queries).max(initial=0)) * float(abs(vectors).max(initial=0)) * max(1, queries.shape[1]) < 2**53:
        queries, vectors = queries.astype(float), vectors.astype(float)  # exact, and faster
    starts = np.arange(0, len(vectors), BLOCK)
    high, low = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = []
    for i, (query, own) in enumerate(zip(queries, query_rows)):
        places, scores = np.empty(0, np.int64), np.empty(0, vectors.dtype)
        for b in order[i]:
            if len(scores) == k and bounds[i, b] < scores[-1]:
                break
            at = np.arange(starts[b], min(starts[b] + BLOCK, len(vectors)))
            at = at[vector_rows[at] != own]
            got = vectors[at] @ query
            if len(scores) == k:
                at, got = at[got >= scores[-1]], got[got >= scores[-1]]
            if len(at):
                places, scores = np.concatenate([places, at]), np.concatenate([scores, got])
                best = np.lexsort((places, -scores))[:k]
                places, scores = places[best], scores[best]
        found.append((np.full(len(places), i), places, scores.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` where ``is_query``, its k best among all other rows.

    A component x becomes floor(scale * x), x as double; the score is the
    integer inner product, and ties go to the smaller vec_id (null last), then
    in the order of the rows. Vectors null or with a null or non-finite component
    take no part; a shorter vector counts as filled with zeros. Each row is a
    candidate of its own, so repeated rows appear repeatedly, and a query row
    meets every row but itself. Fewer than k others: all of them. Scores are
    64-bit integers: where the greatest component would let one be 2**63 or
    more, a ValueError says so and nothing is returned.

    Queries are dealt over parts and candidates over ranges of bounded size, and
    each part meets each range in one task, which passes on k rows a query.
    """
    usable = vectors.filter(is_vector(F.col(vector)))
    rows = usable.select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    greatest = F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double") * scale))))
    count = usable.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(is_query, F.lit(False))).alias("queries"), F.max(F.size(vector)).alias("width"), greatest.alias("greatest")).first()
    if (count.width or 0) * ((count.greatest or 0.0) + 1) ** 2 >= 2.0**63:
        raise ValueError(f"scores of components up to {count.greatest / scale:g} do not fit in 64 bits")
    ranges, parts, width = max(1, -(-count.rows // RANGE)), max(1, -(-count.queries // PART)), count.width or 0
    rows = stored(rows.repartitionByRange(ranges, "vec_id").withColumn("range", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "vectors")
    with_parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("range", "part", "vec_id", "row", "v")
    # With AQE a range may hold several of those asked for; every number below the number of ranges is met once.
    asked = rows.filter("query").select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "vec_id", "row", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        freed()

        right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        queries, places, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(left) and len(right):
            queries, places, scores = block_search(matrix(left.column("v"), width), left.column("row").to_numpy(), matrix(right.column("v"), width), right.column("row").to_numpy(), k)
        asked_at, got_at = left.take(pa.array(queries)), right.take(pa.array(places))
        return pa.table({"query": asked_at.column("row"), "query_id": asked_at.column("vec_id"), "vec_id": got_at.column("vec_id"), "row": got_at.column("row"), "score": pa.array(scores)})

    kind = vectors.schema[vec_id].dataType.simpleString()
    near = asked.groupBy("range", "part").cogroup(with_parts.groupBy("range", "part")).applyInArrow(meet, f"query long, query_id {kind}, vec_id {kind}, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
