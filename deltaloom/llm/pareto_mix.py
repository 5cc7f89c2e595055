"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies each of its documents
is expected to have. The whole part is certain: so many copies of every
document. The rest is a sample of the source: each document draws a random
number u, and documents are ranked by the odds u / (1 - u) over their own
inclusion odds; the sample is the start of that order that fits in the words
still to be taken. A document too long for what is left is passed over, and the
order goes on with those that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Ranges of the ranking that are summed before any is sorted.
RANGES = 4096


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the key alone: the first 12 hex digits of its md5."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, documents, target) for a table of (source, size).

    Sources by code point, null last, weigh ``weights``, repeating. They share
    ``share`` times all sizes; a target stops at ``cap`` times its source's
    size and the excess is shared anew by weight until none is above: with the
    sources in order of cap * size / weight, those up to some place are at
    their cap and the others share the rest. The windows without a partition
    run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    total = total.withColumn("weight", weight)
    everything = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = share * F.sum("source_size").over(everything) - cap * (F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("source_size"))
    level = rest / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The level at the first source that stays below its cap holds for all that do.
    marked = total.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < cap * F.col("source_size"))
    common = F.max(F.when(F.col("open"), F.struct(-F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("open"), F.col("weight") * common).otherwise(cap * F.col("source_size"))
    return marked.withColumn("target", target).select("source", "source_size", "documents", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, passes: int = 4) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    size is the number of words (null text: 0), copies the number of times the
    mix has the document, taken = copies * size. Inclusion odds are those of
    the source's sampled part times the square root of the document's size over
    its source's mean size, so that a budget's end falls on shorter documents.
    passes: how often the order is continued with the documents that still fit;
    what is left of the budget is then mostly shorter than any document left.

    A null source is a source of its own. Documents of size 0 have the certain
    copies alone. The random numbers hang on doc_id alone, so reruns agree;
    rows of one doc_id and size, and all rows of equal rank and size, are taken
    together or not at all. An empty table gives an empty result. Columns of
    the names above are replaced, all others stay.

    No task sorts a whole source: the ranking is cut into ranges, sums of the
    ranges say in which one the budget ends, and only that range is sorted. A
    pass leaves one row for each source: the budget it had and the place in the
    order where it ended, from which each document's copies follow.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in added]
    sizes = stored(docs.select(F.col(doc_id).cast("string").alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = source_targets(sizes, weights, share, cap).withColumn("whole", F.floor(expected)).withColumn("part", expected - F.floor(expected))
    plan = plan.withColumn("left", F.floor(F.col("part") * F.col("source_size") + 0.5).cast("long")).withColumn("cuts", F.array().cast("array<struct<left:bigint,last:struct<rank:double,size:bigint>>>"))
    plan = stored(plan, "plan")
    of_source = lambda d, p: d.join(p.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    drawn = of_source(sizes, plan.filter("part > 0").select("source", "part", "source_size", "documents")).filter("size > 0")
    drawn = drawn.select("source", "size", _rank(F.col("id"), F.col("size")).alias("rank"))
    place = F.floor((F.log2("rank") + 16) * (RANGES / 32))
    drawn = stored(drawn.withColumn("range", F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), place)).cast("int")), "drawn")
    for _ in range(passes):
        fits = of_source(drawn, plan.select("source", "left", "cuts")).filter((F.col("size") <= F.col("left")) & ~_taken(F.col("cuts")))
        sums = fits.groupBy("source", "range").agg(F.sum("size").alias("in_range"), F.first("left").alias("left"))
        upto = F.sum("in_range").over(Window.partitionBy("source").orderBy("range"))
        ranges = stored(sums.withColumn("before", upto - F.col("in_range")).filter("before < left"), "ranges")
        ranges = ranges.select(F.col("source").alias("of"), F.col("range").alias("at"), "before", (F.col("before") + F.col("in_range") <= F.col("left")).alias("inside"))
        near = fits.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
        running = F.col("before") + F.sum("size").over(Window.partitionBy("source", "range").orderBy("rank", "size"))
        ends = near.filter("not inside").withColumn("upto", running).filter("upto <= left").select("source", "rank", "size")
        taken = near.filter("inside").select("source", "rank", "size").unionByName(ends)
        cut = taken.groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("spent"), F.max(F.struct("rank", "size")).alias("last"))
        cuts = F.when(F.col("last").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", F.struct("left", "last")))
        fresh = plan.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("cuts", cuts).withColumn("left", F.col("left") - F.coalesce("spent", F.lit(0)))
        plan = stored(fresh.select(*plan.columns), "plan")
    told = docs.select(F.struct(*keep).alias("doc"), F.col(doc_id).cast("string").alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    # One row for each source on the right: broadcast where small, else a skewed join that AQE splits.
    told = of_source(told, plan).withColumn("rank", F.when((F.col("part") > 0) & (F.col("size") > 0), _rank(F.col("id"), F.col("size"))))
    told = told.withColumn("copies", F.col("whole").cast("long") + F.coalesce(_taken(F.col("cuts")).cast("long"), F.lit(0)))
    return told.select("doc.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _rank(key: Column, size: Column) -> Column:
    """Random odds over inclusion odds; only sums, products, quotients and square roots, which are the same on every machine."""
    u = uniform(F.coalesce(key, F.lit("null")))
    mean = F.col("source_size") / F.col("documents")
    return u / (1 - u) / (F.col("part") / (1 - F.col("part")) * F.sqrt(size / mean))


def _taken(cuts: Column) -> Column:
    """Whether one of the passes took the row: it fitted, and came no later than the last one taken."""
    return F.exists(cuts, lambda c: (F.col("size") <= c["left"]) & (F.struct("rank", "size") <= c["last"]))
