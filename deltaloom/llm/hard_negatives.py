"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, sqrt(greatest squared norm - own squared norm), all
rows have one length, so that for an anchor the order of descending inner
products is the order of ascending distances, and a window of scores is an
annulus of distances around the anchor. A vantage-point tree keeps, for each
half of a node's rows, the least and greatest distance to the node's vantage
row; by the triangle inequality a half outside the annulus is never opened.
Nodes and rows are taken nearest first from one queue, so the first k rows that
come out are the answer.

The top of the tree is dealt over tasks: rows are range-partitioned by their
distance to one vantage row, each range is a shell of bounded size with a tree
of its own, and an anchor goes to the shells its annulus meets.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, freed, stored
from .topk import is_vector, matrix

#: Components of the rows in one shell (8 bytes each), and anchors of one part; a task holds one of each.
SHELL, PART = 1 << 20, 1024
#: Rows of a leaf of the tree.
LEAF = 32


class Tree:
    """A vantage-point tree over rows, told by their places; ``squared`` is the square of the length they have with their last component."""

    def __init__(self, vectors, squared: float):
        import numpy as np

        self.vectors, self.squared = vectors, squared
        exact = vectors.astype(float)
        last = np.sqrt(np.maximum(0, squared - np.einsum("ij,ij->i", exact, exact)))
        #: Of each node: its vantage row (-1: a leaf), its children with least and greatest distance to it, the places of a leaf.
        self.vantage: list[int] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self.places: list = []
        random = np.random.default_rng(0)
        todo = [(np.arange(len(vectors)), -1, (0.0, 0.0))] if len(vectors) else []
        while todo:
            rows, parent, shell = todo.pop()
            node = len(self.vantage)
            if parent >= 0:
                self.children[parent].append((node, *shell))
            leaf = len(rows) <= LEAF
            self.vantage.append(-1 if leaf else int(rows[random.integers(len(rows))]))
            self.children.append([])
            self.places.append(np.sort(rows) if leaf else None)
            if not leaf:
                v = self.vantage[node]
                distance = np.sqrt(np.maximum(0, 2 * squared - 2 * (exact[rows] @ exact[v] + last[rows] * last[v])))
                for half in np.array_split(np.argsort(distance, kind="stable"), 2):
                    todo.append((rows[half], node, (float(distance[half[0]]), float(distance[half[-1]]))))

    def to_vantages(self, queries):
        """Distances of queries, whose last component is 0, to the vantage rows of all nodes (a column a node; 0 for leaves)."""
        import numpy as np

        inside = [n for n, v in enumerate(self.vantage) if v >= 0]
        out, q = np.zeros((len(queries), len(self.vantage))), queries.astype(float)
        if inside:
            inner = q @ self.vectors[[self.vantage[n] for n in inside]].T.astype(float)
            out[:, inside] = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", q, q)[:, None] + self.squared - 2 * inner))
        return out

    def nearest(self, query, to_vantage, wanted, lows, highs, k: int):
        """(window, place, score) of the first k wanted rows of each window of scores: high scores first, ties to the smaller place.

        wanted: which rows count. Nodes wait in the queue with the highest score
        that they could hold, rows with their own; so a row that comes out is the
        next of all. A window is closed when it has its k rows or its lowest
        score is passed, and the search ends with the last window.
        """
        own = float(query.astype(float) @ query.astype(float))
        slack = 1e-9 * (own + self.squared) + 0.5  # scores are whole numbers, distances are not
        found: list[list[tuple[int, int]]] = [[] for _ in lows]
        open_ = set(range(len(lows)))
        lowest, highest = min(lows), max(highs)
        queue = [(-float("inf"), 0, 0)] if self.vantage else []
        while queue and open_:
            bound, is_row, at = heappop(queue)
            if -bound < lowest:
                break
            if is_row:
                score = -bound
                for w in tuple(open_):
                    if lows[w] <= score <= highs[w]:
                        found[w].append((at, score))
                    if score < lows[w] or len(found[w]) == k:
                        open_.discard(w)
                        lowest = min((lows[w] for w in open_), default=lowest)
            elif self.vantage[at] < 0:
                places = self.places[at][wanted[self.places[at]]]
                scores = self.vectors[places] @ query
                fits = (scores >= lowest) & (scores <= highest)
                for place, score in zip(places[fits].tolist(), scores[fits].tolist()):
                    heappush(queue, (-score, 1, place))
            else:
                d = float(to_vantage[at])
                for child, least, greatest in self.children[at]:
                    near, far = max(0.0, d - greatest, least - d), d + greatest
                    top = (own + self.squared - near * near) / 2 + slack
                    if top >= lowest and (own + self.squared - far * far) / 2 - slack <= highest:
                        heappush(queue, (max(bound, -top), 0, child))
        return [(w, place, score) for w, rows in enumerate(found) for place, score in rows]


def _rows(vectors: DataFrame, vec_id: str, vector: str, label: str, is_anchor: Column, scale: float) -> DataFrame:
    usable = is_vector(F.col(vector)) & F.col(label).isNotNull()
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.filter(usable).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def _inner(v: Column, other: list[int]) -> Column:
    fixed = F.array(*(F.lit(float(x)) for x in other)) if other else F.array().cast("array<double>")
    return F.aggregate(F.zip_with(v, fixed, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda total, x: total + x)


def mine(vectors: DataFrame, is_anchor: Column, k: int = 5, positives: int = 5, least: tuple[int, int] = (80, 100), most: tuple[int, int] = (100, 100), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows where ``is_anchor``.

    A component x becomes floor(scale * x), x as double; a score is the integer
    inner product with the anchor. Higher scores come first, ties go to the
    smaller vec_id (null last), then in the order of the rows. An anchor's
    positives are its first ``positives`` other rows of its label (all, if
    fewer). For each of them the first ``k`` rows of another label (all, if
    fewer) are returned whose score is at least least[0]/least[1] and at most
    most[0]/most[1] times the positive's, compared in whole numbers. Rows with a
    null label, a null vector or a null or non-finite component take no part; a
    shorter vector counts as filled with zeros. Repeated rows count each for
    themselves, an anchor row meets every row but itself. Without positives or
    negatives there are no rows. Where the greatest component would let a score
    (times the window's factors) be 2**63 or more, a ValueError says so.

    Two searches: for the positives every shell may hold the best, for the
    negatives only shells that the widest annulus of the anchor meets. A task
    holds one shell and one part of the anchors and passes on k rows a window.
    """
    rows = stored(_rows(vectors, vec_id, vector, label, is_anchor, scale), "rows")
    seen = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("greatest"), F.max(_squared(F.col("v"))).alias("squared"), F.min_by("v", "row").alias("vantage")).first()
    width, factor = seen.width or 0, max(1, *map(abs, (*least, *most)))
    if width * ((seen.greatest or 0.0) + 1) ** 2 * factor >= 2.0**63:
        raise ValueError(f"scores of components up to {seen.greatest / scale:g} do not fit in 64 bits")
    squared, vantage = seen.squared or 0.0, list(seen.vantage or [])
    vantage_squared = float(sum(x * x for x in vantage))
    shells, parts = max(1, -(-seen.rows * max(1, width) // SHELL)), max(1, -(-seen.anchors // PART))

    # Distance to the vantage row, both with their last component.
    lacks = lambda s: F.sqrt(F.greatest(F.lit(squared) - s, F.lit(0.0)))
    product = _inner(F.col("v"), vantage) + lacks(_squared(F.col("v"))) * lacks(F.lit(vantage_squared))
    at = F.sqrt(F.greatest(F.lit(2 * squared) - 2 * product, F.lit(0.0)))
    in_shells = stored(rows.withColumn("at", at).repartitionByRange(shells, "at", "row").withColumn("shell", F.spark_partition_id()), "shells")
    dropped(rows)
    bounds = stored(in_shells.groupBy("shell").agg(F.min("at").alias("inner"), F.max("at").alias("outer")), "bounds")
    last = bounds.agg(F.max("shell")).first()[0] or 0
    # New names for the columns: a cogroup of two selections of one table takes equal ones for each other.
    members = in_shells.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *(F.col(c).alias(c) for c in ("shell", "vec_id", "row", "label", "v")))
    anchors = in_shells.filter("anchor").select("vec_id", "row", "label", "v", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    kind = vectors.schema[vec_id].dataType.simpleString()

    def search(asked: DataFrame, same_label: bool, wanted: int) -> DataFrame:
        """asked: anchors with the arrays windows, lows, highs, one row for each shell to look at."""

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            import numpy as np

            freed()
            out = []
            if len(left) and len(right):
                right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])
                own, queries = matrix(right.column("v"), width), matrix(left.column("v"), width)
                ids, known = right.column("row").to_numpy(), {}
                names = np.array([known.setdefault(x, len(known)) for x in right.column("label").to_pylist()])
                tree = Tree(own, squared)
                to_vantage = tree.to_vantages(queries)
                for i, (row, name, windows, lows, highs) in enumerate(zip(*(left.column(c).to_pylist() for c in ("row", "label", "windows", "lows", "highs")))):
                    of_label = names == known.get(name, -1)
                    fits = (of_label if same_label else ~of_label) & (ids != row)
                    out += [(row, left.column("vec_id")[i].as_py(), windows[w], place, score) for w, place, score in tree.nearest(queries[i], to_vantage[i], fits, lows, highs, wanted)]
            columns = list(zip(*out)) if out else [()] * 5
            found = right.take(pa.array(columns[3], pa.int64()))
            return pa.table({"anchor": pa.array(columns[0], pa.int64()), "anchor_id": pa.array(columns[1], left.schema.field("vec_id").type), "window": pa.array(columns[2], pa.int64()), "vec_id": found.column("vec_id"), "row": found.column("row"), "score": pa.array(columns[4], pa.int64())})

        near = asked.groupBy("shell", "part").cogroup(members.groupBy("shell", "part")).applyInArrow(meet, f"anchor long, anchor_id {kind}, window long, vec_id {kind}, row long, score long")
        rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
        return near.withColumn("rank", rank).filter(F.col("rank") <= wanted)

    every = F.array(F.lit(0).cast("long"))
    everywhere = anchors.withColumns({"shell": F.explode(F.sequence(F.lit(0), F.lit(last))), "windows": every, "lows": F.array(F.lit(-(2**63) + 1)), "highs": F.array(F.lit(2**63 - 1))})
    best = stored(search(everywhere, True, positives).select("anchor", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # least * p <= score * d in whole numbers is score >= ceil(least * p / d); the other side likewise.
    p = F.col("positive_score")
    down = lambda a, b: F.expr(f"positive_score * {a} div {b} - if(positive_score * {a} % {b} < 0, 1, 0)")
    up = lambda a, b: F.expr(f"positive_score * {a} div {b} + if(positive_score * {a} % {b} > 0, 1, 0)")
    told = best.select("anchor", "window", up(*least).alias("low"), down(*most).alias("high")).filter("low <= high")
    told = told.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    told = told.select("anchor", *(F.col(f"w.{f}").alias(f"{f}s") for f in ("window", "low", "high")))
    own = _squared(F.col("v"))
    ring = lambda score: F.sqrt(F.greatest(own + F.lit(squared) - 2 * score, F.lit(0.0)))
    from_vantage = F.sqrt(F.greatest(own + F.lit(squared) - 2 * _inner(F.col("v"), vantage), F.lit(0.0)))
    annuli = anchors.join(told, anchors["row"] == told["anchor"]).drop("anchor").withColumns({"from_vantage": from_vantage, "near": ring(F.array_max("highs").cast("double")), "far": ring(F.array_min("lows").cast("double"))})
    slack = 1e-6 * (squared**0.5 + 1)
    met = (F.col("from_vantage") - F.col("outer") <= F.col("far") + slack) & (F.col("inner") - F.col("from_vantage") <= F.col("far") + slack) & (F.col("from_vantage") + F.col("outer") >= F.col("near") - slack)
    asked = annuli.withColumn("shell", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(bounds, "shell").filter(met).drop("inner", "outer", "from_vantage", "near", "far")
    hard = search(asked, False, k).select("anchor", "anchor_id", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(best, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
