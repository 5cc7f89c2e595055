"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to it if their inner product exceeds
a threshold, that is, if it lies in the filter's cap. The directions are a
random product code: after a random rotation the space is cut into parts, each
with a few random code words, and every choice of one word per part is a
direction. So a vector's filters are listed without trying them all: a choice
is given up as soon as the best words of the parts still to come could not lift
the sum over the threshold. Vectors are joined on filters and verified.

No pair is written out. A filter counts a link if it is the first one that both
vectors have, and passes on each vector's count and the edges of a spanning
forest of the links it saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import components, dropped, lean, stored
from .topk import is_vector, matrix

#: Vectors of a filter compared at once; a larger filter is cut into blocks and each pair of blocks is compared.
BLOCK = 1024
#: Least dimensions of a part: vectors of fewer are filled with zeros before the rotation, which changes no cosine.
AXES = 16


@cache
def product_code(width: int, parts: int, words: int, expected: float, seed: int):
    """Rotated code words of each part, and the threshold that lets ``expected`` filters hold a random vector on average."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    code = []
    for axes in np.array_split(np.arange(width), parts):
        w = rng.standard_normal((words, len(axes)))
        w *= np.sqrt(len(axes) / width) / np.linalg.norm(w, axis=1, keepdims=True)
        code.append(w @ rotation[axes])
    random = rng.standard_normal((1000, width))
    total = np.zeros((1000, 1))
    for w in code:
        total = (total[:, :, None] + (random / np.linalg.norm(random, axis=1, keepdims=True) @ w.T)[:, None, :]).reshape(1000, -1)
    return code, float(np.quantile(total, 1 - min(1.0, expected / words**parts)))


def list_decode(unit, code, threshold: float):
    """(row, filter) of all filters whose inner product with a row of ``unit`` is at least ``threshold``."""
    import numpy as np

    scores = [unit @ words.T for words in code]
    rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
    row, name, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for p, s in enumerate(scores):
        need = threshold - (rest[p + 1] if p + 1 < len(scores) else np.zeros(len(unit)))
        at, word = np.nonzero(total[:, None] + s[row] >= need[row][:, None])
        row, name, total = row[at], name[at] * s.shape[1] + word, total[at] + s[row[at], word]
    return row, name


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, parts: int = 2, words: int = 32, codes: int = 16, expected: float = 3.0, seed: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Two vectors of the same non-null label are linked if their cosine, in
    double precision, is at least ``least``. n_links: other rows linked
    directly. component_id: smallest vec_id reachable by links, itself
    included; kept: vec_id = component_id (so repeated rows of one vec_id are
    all kept, and a null vec_id is kept only where a component has no other).
    Vectors null, zero, or with null or non-finite components, and vectors
    with a null label or of unequal length, link with nothing.

    There are ``codes`` independent product codes, and ``expected`` filters of
    each hold a vector on average. Few words and many codes make the number of a
    vector's filters even, which is what the miss probability hangs on: at a
    cosine of 0.98 none of 6,000 random pairs in 2 to 128 dimensions (of 1,000 in
    768) shared no filter (the tests hold it below 0.002). Equal vectors are one
    class, compared once. Filters with many classes are cut into blocks, and a
    task holds two blocks at a time. What is written grows with the vectors, not
    with the links.
    """
    values = F.col(vector).cast("array<double>")
    top = F.array_max(F.transform(values, F.abs))
    usable = is_vector(F.col(vector)) & F.col(label).isNotNull() & F.coalesce(top > 0, F.lit(False))
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = stored(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.when(usable, F.col(vector)).alias("v")), "vectors")
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("members"))
    # The class number is 16 bytes of a hash, so it does not depend on a run.
    number = F.unhex(F.substring(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("string")), 256), 1, 32))
    # Nodes are in the order of their least vec_id, null last, so that the smallest of a component names it.
    node = F.struct(F.col("least_id").isNull().alias("without"), "least_id", "class").alias("node")
    classes = stored(classes.withColumn("class", number).select("*", node), "classes")

    @lean
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                some = batch.filter(pa.array(lengths == width))
                v = matrix(pa.chunked_array([some.column("v")]), int(width)).astype(float)
                v = v / abs(v).max(axis=1, keepdims=True)
                unit = np.zeros((len(v), max(int(width), AXES * parts)))
                unit[:, :width] = v / np.linalg.norm(v, axis=1, keepdims=True)
                listed = [list_decode(unit, *product_code(unit.shape[1], parts, words, expected, seed + c)) for c in range(codes)]
                row = np.concatenate([r for r, _ in listed])
                name = np.concatenate([n + c * words**parts for c, (_, n) in enumerate(listed)])
                by = np.lexsort((name, row))
                ends = np.searchsorted(row[by], np.arange(len(v) + 1))
                filters = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(name[by], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("class", "label", "v")), filters, pa.array(np.full(len(v), width, np.int32))], names=["class", "label", "v", "filters", "width"])

    held = stored(classes.select("class", "label", "v").mapInArrow(decode, classes.select("class", "label", "v").schema.add("filters", ArrayType(IntegerType())).add("width", "integer")), "filters")
    key = ["label", "width", "filter"]
    listed = held.select("class", "label", "width", F.explode("filters").alias("filter"))
    sizes = listed.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    placed = listed.join(sizes, key).withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("own", block)
    # Each pair of blocks is one unit; a block goes to the units it is part of.
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    units = units.select(F.xxhash64(*key, F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "filter", "own", "other", "class")
    told = held.join(classes.select("class", "members", "node"), "class").select("class", "v", "filters", "members", "node")
    units = units.join(told, "class").drop("class").repartition("unit").sortWithinPartitions("unit")

    def near(unit: pa.Table):
        """Whether two vectors of a unit are linked (a matrix)."""
        import numpy as np

        v = matrix(unit.column("v"), len(unit.column("v")[0])).astype(float)
        v = v / abs(v).max(axis=1, keepdims=True)
        square = np.sqrt(np.einsum("ij,ij->i", v, v))
        cosine = (v @ v.T) / square[:, None] / square
        linked = cosine >= least
        a, b = np.nonzero(np.triu(abs(cosine - least) <= 1e-9, 1))  # these are judged by the plain sum
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            linked[i, j] = linked[j, i] = np.einsum("ij,ij->i", v[i], v[j]) / (square[i] * square[j]) >= least
        np.fill_diagonal(linked, False)
        own, other = unit.column("own").to_numpy(), unit.column("other").to_numpy()
        # Pairs within a block belong to the unit of that block alone.
        return linked & ((own[:, None] != own) | (own == other))

    def seen_before(unit: pa.Table):
        """Whether two vectors share a filter with a smaller number than the unit's (a matrix)."""
        import numpy as np

        lists = unit.column("filters").combine_chunks()
        row = np.repeat(np.arange(len(unit)), lists.value_lengths().to_numpy(zero_copy_only=False))
        name = lists.flatten().to_numpy()
        earlier = name < unit.column("filter")[0].as_py()
        distinct, at = np.unique(name[earlier], return_inverse=True)
        holds = np.zeros((len(unit), len(distinct)), np.float32)
        holds[row[earlier], at] = 1
        return holds @ holds.T > 0

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def links(unit: pa.Table) -> pa.RecordBatch:
            linked = near(unit)
            if not linked.any():
                return None
            count = (linked & ~seen_before(unit)) @ unit.column("members").to_numpy().astype(float)
            # A spanning forest: from each vector not yet reached, all that its links reach.
            root = np.full(len(unit), -1)
            for start in np.flatnonzero(linked.any(axis=1)):
                wave = np.array([start]) if root[start] < 0 else np.empty(0, int)
                while len(wave):
                    root[wave] = start
                    wave = np.flatnonzero(linked[wave].any(axis=0) & (root < 0))
            told = np.flatnonzero(root >= 0)
            nodes = unit.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(told)), pa.array(count[told].astype(np.int64)), nodes.take(pa.array(root[told]))], names=["node", "linked", "root"])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            unit = rows.column("unit").to_numpy()
            starts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist()]
            for s, e in zip(starts, starts[1:]):
                if e - s > 1 and (found := links(rows.slice(s, e - s))):
                    yield found
            rest = rows.slice(starts[-1])
        if rest is not None and len(rest) > 1 and (found := links(rest)):
            yield found

    node = classes.schema["node"].dataType.simpleString()
    found = stored(units.mapInArrow(verify, f"node {node}, linked long, root {node}"), "links")
    edges = found.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    groups = components(edges).withColumnRenamed("id", "node")
    degree = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    in_group = classes.join(degree, "node", "left").join(groups, "node", "left")
    told = in_group.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node")["least_id"].alias("component_id"))
    # One row per class on the right: a hot class is a skewed join, which AQE splits.
    out = rows.join(told, (rows["label"] == told["l"]) & (rows["v"] == told["w"]), "left")
    component = F.coalesce("component_id", "vec_id").cast(kind)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
