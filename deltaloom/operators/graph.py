"""Dependency graphs: resolution, alternatives, closures, levels, cycles."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a round: written to spark.checkpoint.dir; cached where a session on one machine names none. ``released`` undoes it."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return df.persist()
    path = f"{folder.rstrip('/')}/deltaloom-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._deltaloom_path = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Gives up kept tables that nothing reads any more; only those written to files, as what is cached may still be part of a plan."""
    for df in tables:
        path = getattr(df, "_deltaloom_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)``, by sorting and never by a broadcast: Spark judges tables by the size of their files, and those of a few narrow columns are many times as large in the driver's memory."""
    return left.join(right.hint("merge"), on, how)


#: Rows up to which a graph is walked within one task (some MB at most); a larger one goes by rounds of joins. Both give the same rows.
SMALL = 1 << 16


def _is_small(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL


def _walked(pairs: DataFrame, walk: Callable[[list, list], tuple[list, list]], schema: str) -> DataFrame:
    """What ``walk`` makes of the two columns of a small table, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [b.to_pydict() for b in batches]
        left, right = walk(*([x for d in told for x in list(d.values())[i]] for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(left, out[0].type), pa.array(right, out[1].type)], schema=out)

    out = to_arrow_schema(pairs.sparkSession.createDataFrame([], schema).schema)
    return pairs.repartition(1).mapInArrow(run, schema)


def _rings(sources: list, targets: list) -> tuple[list, list]:
    """Nodes on cycles, each with the smallest of its strongly connected nodes."""
    after: dict = {}
    for s, t in zip(sources, targets):
        after.setdefault(s, set()).add(t)
        after.setdefault(t, set())
    before: dict = {n: [] for n in after}
    for s, ts in after.items():
        for t in ts:
            before[t].append(s)

    def visited(start, ways, seen) -> list:
        """Nodes reached from start, each after all that are reached from it."""
        out, stack = [], [(start, iter(ways[start]))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            further = next((n for n in rest if n not in seen), None)
            if further is None:
                out.append(node)
                stack.pop()
            else:
                seen.add(further)
                stack.append((further, iter(ways[further])))
        return out

    seen: set = set()
    order = [n for start in after if start not in seen for n in visited(start, after, seen)]
    seen, found = set(), []
    for start in reversed(order):
        if start not in seen:
            ring = visited(start, before, seen)
            if len(ring) > 1 or start in after[start]:
                found += [(n, min(ring)) for n in ring]
    return [n for n, _ in found], [c for _, c in found]


def _depths(sources: list, targets: list) -> tuple[list, list]:
    """Nodes, as targets of null or of other nodes, with the longest way to them; null on a cycle or behind one."""
    after: dict = {t: [] for t in targets}
    waits = dict.fromkeys(after, 0)
    for s, t in zip(sources, targets):
        if s is not None:
            after[s].append(t)
            waits[t] += 1
    level, now, depth = {}, [n for n, w in waits.items() if not w], 0
    while now:
        level |= dict.fromkeys(now, depth)
        free = []
        for n in now:
            for t in after[n]:
                waits[t] -= 1
                if not waits[t]:
                    free.append(t)
        now, depth = free, depth + 1
    return list(after), [level.get(n) for n in after]


def _reached(sources: list, targets: list) -> tuple[list, list]:
    """All nodes that ways lead to from the targets of null, and how many steps away they are."""
    after: dict = {}
    for s, t in zip(sources, targets):
        after.setdefault(s, []).append(t)
    steps = dict.fromkeys(after.get(None, []), 0)
    now = list(steps)
    while now:
        further = dict.fromkeys(t for n in now for t in after.get(n, []) if t not in steps)
        steps |= dict.fromkeys(further, steps[now[0]] + 1)
        now = list(further)
    return list(steps), list(steps.values())


def reachable(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", most_rounds: int | None = None) -> DataFrame:
    """(node): seeds and all nodes that edges lead to from them, at most ``most_rounds`` steps away; cycles end by themselves.

    Frontier by frontier, a join a round; at most ``SMALL`` edges and seeds are walked in one task instead.
    """
    arrows = kept(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s is not null and t is not null").distinct())
    seen = kept(seeds.select(F.col(seeds.columns[0]).alias("node")).filter("node is not null").distinct())
    pairs = arrows.unionByName(seen.select(F.lit(None).cast(seen.schema["node"].dataType).alias("s"), F.col("node").alias("t")))
    if _is_small(pairs):
        walked = _walked(pairs.select("s", "t"), _reached, f"node {pairs.schema['t'].dataType.simpleString()}, steps int")
        return (walked if most_rounds is None else walked.filter(F.col("steps") <= most_rounds)).select("node")
    frontier, rounds = seen, 0
    while most_rounds is None or rounds < most_rounds:
        frontier = kept(frontier.join(arrows, F.col("node") == F.col("s")).select(F.col("t").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        seen, rounds = seen.unionByName(frontier), rounds + 1
    return seen


#: Levels after which ``walks`` looks for a cycle.
LONG = 16


def walks(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", most_rounds: int | None = None) -> DataFrame:
    """(root, node, level): every walk along the edges from each seed, the seed itself at level 0; one row for each way to a node.

    A round is one join and is kept once. Walks that lead round a cycle have no
    end: without ``most_rounds`` a cycle that the seeds lead to raises an error
    (looked for once, when walks get longer than ``LONG``), with it more than that
    many rounds do; no number of rows or levels does.
    """
    arrows = kept(edges.select(F.col(source).alias("node"), F.col(target).alias("t")).filter("node is not null and t is not null"))
    name = F.col(seeds.columns[0])
    frontier = kept(seeds.select(name.alias("root"), name.alias("node"), F.lit(0).alias("level")))
    found, rounds = frontier, 0
    while frontier.limit(1).count():
        if rounds == most_rounds:
            if frontier.join(arrows, "node", "left_semi").limit(1).count():
                raise ValueError(f"walks of more than {most_rounds} edges")
            break
        if most_rounds is None and rounds == LONG:
            ring = cycles(arrows.join(kept(reachable(arrows, seeds, "node", "t")), "node", "left_semi"), "node", "t").select(F.min("node")).first()[0]
            if ring is not None:
                raise ValueError(f"walks lead round a cycle at {ring}")
        frontier = kept(frontier.join(arrows, "node").select("root", F.col("t").alias("node"), (F.col("level") + 1).alias("level")))
        found, rounds = found.unionByName(frontier), rounds + 1
    return found


def levels(nodes: DataFrame, edges: DataFrame, node: str = "node", source: str = "source", target: str = "target") -> DataFrame:
    """(node, level): the longest chain of edges source -> target that ends in the node; nodes without a source are at 0.

    Nodes are taken off round by round: those all of whose sources are gone. What is on a
    cycle or behind one gets a null level. At most ``SMALL`` nodes and edges are walked in
    one task instead.
    """
    left = kept(nodes.select(F.col(node).alias("node")).distinct())
    arrows = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    arrows = kept(met(met(arrows, left.select(F.col("node").alias("s")), "s", "left_semi"), left.select(F.col("node").alias("t")), "t", "left_semi"))
    kind = left.schema["node"].dataType
    pairs = arrows.unionByName(left.select(F.lit(None).cast(kind).alias("s"), F.col("node").alias("t")))
    if _is_small(pairs):
        return _walked(pairs.select("s", "t"), _depths, f"node {kind.simpleString()}, level int")
    done, level = None, 0
    while True:
        free = kept(met(left, arrows.select(F.col("t").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if not free.limit(1).count():
            break
        done = free if done is None else done.unionByName(free)
        left = kept(met(left, free, "node", "left_anti"))
        arrows = kept(met(arrows, free.select(F.col("node").alias("s")), "s", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def least_reaching(arrows: DataFrame) -> DataFrame:
    """(node, label): of each end of ``arrows`` (s, t) the smallest node from which a way leads to it, itself included.

    Labels go along the arrows, two at a time, and then on to the label of the
    label, which leads there, too; so rounds are near the logarithm of the
    longest way that a label travels. A round is kept, the one before released.
    """
    label = kept(arrows.select(F.explode(F.array("s", "t")).alias("node")).distinct().withColumn("label", F.col("node")))

    def along(now: DataFrame) -> DataFrame:
        told = met(arrows, now.withColumnsRenamed({"node": "s"}), "s").select(F.col("t").alias("node"), "label")
        return now.unionByName(told).groupBy("node").agg(F.min("label").alias("label"))

    while True:
        near = along(along(label.select("node", "label")))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
        was = label.select("node", F.col("label").alias("was"))
        fresh = kept(met(met(near, jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), was, "node"))
        if not fresh.filter("label <> was").limit(1).count():
            return fresh.select("node", "label")
        released(label)
        label = fresh


def cycles(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, cycle): nodes on a cycle, self-loops included, each with the smallest node of those it shares cycles with.

    Nodes without a way in or out are taken off. Then each node learns the
    smallest node that reaches it and, among nodes of one such label, the smallest
    that it reaches; nodes for which both are one lie on cycles with it. They are
    taken out, and the rest goes round again. Rows stay as many as the edges. A
    graph of at most ``SMALL`` edges is walked in one task instead.
    """
    arrows = kept(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s is not null and t is not null").distinct())
    if _is_small(arrows):
        kind = arrows.schema["s"].dataType.simpleString()
        return _walked(arrows.select("s", F.col("t").cast(kind)), _rings, f"node {kind}, cycle {kind}")
    found = None
    while True:
        n_arrows = arrows.count()
        while n_arrows:
            trimmed = kept(met(met(arrows, arrows.select(F.col("t").alias("s")).distinct(), "s", "left_semi"), arrows.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"))
            before, n_arrows, arrows = n_arrows, trimmed.count(), trimmed
            if n_arrows == before:
                break
        if not n_arrows:
            break
        colour = least_reaching(arrows)
        of = lambda end: colour.withColumnsRenamed({"node": end, "label": f"of_{end}"})
        same = kept(met(met(arrows, of("s"), "s"), of("t"), "t").filter("of_s = of_t").select("s", "t"))
        back = least_reaching(same.select(F.col("t").alias("s"), F.col("s").alias("t"))).withColumnRenamed("label", "back")
        # A node that has no arrow among those of its label is alone.
        core = kept(met(colour, back, "node", "left").filter("label = coalesce(back, node)").select("node", F.col("label").alias("cycle")))
        # A node alone is on a cycle only by an edge to itself.
        inside = met(met(same, core.select(F.col("node").alias("s")), "s", "left_semi"), core.select(F.col("node").alias("t")), "t", "left_semi")
        members = met(core, inside.select(F.col("s").alias("node")).distinct(), "node", "left_semi")
        found = members if found is None else found.unionByName(members)
        arrows = kept(met(met(arrows, core.select(F.col("node").alias("s")), "s", "left_anti"), core.select(F.col("node").alias("t")), "t", "left_anti").select("s", "t"))
    return found if found is not None else arrows.select(F.col("s").alias("node"), F.col("t").alias("cycle")).limit(0)


def on_cycles(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node): nodes that lie on a cycle, self-loops included."""
    return cycles(edges, source, target).select("node")


def without_cycles(edges: DataFrame, options: DataFrame, breakers: DataFrame) -> DataFrame:
    """(node, target, depset_id): the edges, one option of each dependency set, and breakers instead of nodes, so that no cycle is left.

    edges: (node, target). options: (depset_id, node, target, priority), of which
    the first by priority and target is taken. breakers: (node, breaker). As long
    as there are cycles, in each of them one set (the smallest id that has an
    option left and whose edge lies within) goes on to its next option, which it
    keeps; a cycle without such a set has the edges within to its smallest node
    that has a breaker led to the breaker; a cycle without either raises an
    error. All cycles are mended at once in a round, each change is made once,
    so the rounds end.
    """
    place = Window.partitionBy("depset_id").orderBy("priority", "target")
    fixed = edges.select("node", "target", F.lit(None).cast(options.schema["depset_id"].dataType).alias("depset_id"), F.lit(1).alias("place"), F.lit(1).alias("of"))
    ranked = options.select("node", "target", "depset_id", F.row_number().over(place).alias("place"), F.count("*").over(Window.partitionBy("depset_id")).cast("int").alias("of"))
    ranked = kept(ranked)
    now = kept(fixed.unionByName(ranked.filter("place = 1")))
    breaker = breakers.groupBy("node").agg(F.min("breaker").alias("breaker"))
    while True:
        on = kept(cycles(now, "node", "target"))
        if not on.limit(1).count():
            return now.select("node", "target", "depset_id")
        ends = on.withColumnsRenamed({"node": "target", "cycle": "to_cycle"})
        marked = kept(now.join(on, "node", "left").join(ends, "target", "left").withColumn("inside", F.when(F.col("cycle") == F.col("to_cycle"), F.col("cycle"))).drop("cycle", "to_cycle"))
        turn = marked.filter("inside is not null").groupBy(F.col("inside").alias("cycle")).agg(F.min(F.when((F.col("depset_id").isNotNull()) & (F.col("place") < F.col("of")), F.col("depset_id"))).alias("turn"))
        cut = on.join(breaker, "node").groupBy("cycle").agg(F.min(F.struct("node", "breaker")).alias("cut"))
        mended = kept(turn.join(cut, "cycle", "left").select(F.col("cycle").alias("inside"), "turn", "cut"))
        stuck = mended.filter("turn is null and cut is null").select(F.min("inside")).first()[0]
        if stuck is not None:
            told = on.filter(F.col("cycle") == F.lit(stuck)).select(F.col("node").cast("string")).orderBy("node").limit(20)
            raise ValueError("nothing breaks the cycle of " + ", ".join(r.node for r in told.collect()))
        told = marked.join(mended, "inside", "left")
        goes_on = F.coalesce(F.col("depset_id") == F.col("turn"), F.lit(False))
        to = F.when(F.col("turn").isNull() & (F.col("target") == F.col("cut.node")), F.col("cut.breaker")).otherwise(F.col("target"))
        stay = told.filter(~goes_on).select("node", to.alias("target"), "depset_id", "place", "of")
        step = told.filter(goes_on).select("depset_id", (F.col("place") + 1).alias("place"))
        now = kept(stay.unionByName(ranked.join(step, ["depset_id", "place"]).select("node", "target", "depset_id", "place", "of")))


def resolved(edges: DataFrame, objects: DataFrame, required: Column | None = None) -> DataFrame:
    """Edges (from_fqn, to_qn) with to_fqn: the object of that fqn, else the smallest fqn of those with that pqn, else null.

    An edge to an fqn that several objects have raises an error, and so does one
    that resolves to nothing where ``required`` holds.
    """
    full = objects.groupBy(F.col("fqn").alias("to_qn")).agg(F.count("*").alias("many"))
    partial = objects.filter("pqn is not null").groupBy(F.col("pqn").alias("to_qn")).agg(F.min("fqn").alias("by_pqn"))
    once = F.when(F.col("many") > 1, F.raise_error(F.concat(F.lit("several objects are called "), F.col("to_qn"))).cast("string")).when(F.col("many") == 1, F.col("to_qn"))
    found = F.coalesce(once, F.col("by_pqn"))
    if required is not None:
        found = F.when(required & found.isNull(), F.raise_error(F.concat(F.lit("nothing is called "), F.col("to_qn"))).cast("string")).otherwise(found)
    return edges.join(full, "to_qn", "left").join(partial, "to_qn", "left").withColumn("to_fqn", found).drop("many", "by_pqn")


def resolved_on_side(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges (…, to_qn, side) with to_fqn: of the objects of that fqn, else of that pqn, the smallest fqn on the edge's side, else on any; null without one.

    objects: (fqn, pqn, side). Objects are summed up by name before they meet the edges.
    """
    names = objects.select(F.col("fqn").alias("to_qn"), "fqn", "side", F.lit(0).alias("way")).unionByName(objects.filter("pqn is not null").select(F.col("pqn").alias("to_qn"), "fqn", "side", F.lit(1).alias("way")))
    best = names.groupBy("to_qn", "side").agg(F.min(F.struct("way", "fqn")).alias("best"))
    by_name = best.groupBy("to_qn").agg(F.map_from_entries(F.collect_list(F.struct("side", "best"))).alias("sides"), F.min("best").alias("any"))
    here = F.try_element_at("sides", F.col("side"))
    # A full name anywhere comes before a partial one on the side.
    found = F.when(here["way"] <= F.col("any.way"), here["fqn"]).otherwise(F.col("any.fqn"))
    return edges.join(by_name, "to_qn", "left").withColumn("to_fqn", found).drop("sides", "any")


def chosen_alternatives(candidates: DataFrame, existing: DataFrame, depset: str = "depset_id", target: str = "to_fqn", priority: str = "priority") -> DataFrame:
    """Of each dependency set the candidate of least priority (null: 100), then least name, that exists."""
    there = candidates.join(existing.select(F.col(existing.columns[0]).alias(target)).distinct(), target, "left_semi")
    order = Window.partitionBy(depset).orderBy(F.coalesce(F.col(priority), F.lit(100)), target)
    return there.withColumn("deltaloom_place", F.row_number().over(order)).filter("deltaloom_place = 1").drop("deltaloom_place")


def fallbacks(depsets: DataFrame, chosen: DataFrame, depset: str = "depset_id") -> DataFrame:
    """Dependency sets for which nothing was chosen, each with the start and end node of its fallback."""
    open_ = depsets.join(chosen.select(depset).distinct(), depset, "left_anti")
    unmet = F.when(F.col("fallback").isNull(), F.raise_error(F.concat(F.lit("no candidate and no fallback: "), F.col(depset).cast("string"))).cast("string")).otherwise(F.col("fallback"))
    return open_.withColumn("fallback", unmet).select("*", F.explode(F.array(F.lit("fallback"), F.lit("endfallback"))).alias("action"))


def fallback_edges(unmet: DataFrame) -> DataFrame:
    """(node, target): the edges around nodes that need a fallback; node waits for target.

    unmet: (node, fallback, side). A node comes after the start of its fallback
    and before its end. Each fallback has one start and end on a side, whoever
    needs it; where both sides need it, the build side's start waits for the
    drop side's end. Rows with a null in node, fallback or side give no edge.
    """
    end = lambda kind, side: F.concat(F.lit(kind), side, F.lit("."), F.col("fallback"))
    known = unmet.filter("node is not null and fallback is not null and side is not null")
    around = known.select(F.inline(F.array(
        F.struct(F.col("node").cast("string").alias("node"), end("fallback.", F.col("side")).alias("target")),
        F.struct(end("endfallback.", F.col("side")).alias("node"), F.col("node").cast("string").alias("target")),
    )))
    both = known.groupBy("fallback").agg(F.bool_or(F.col("side") == "build").alias("builds"), F.bool_or(F.col("side") == "drop").alias("drops")).filter("builds and drops")
    return around.distinct().unionByName(both.select(end("fallback.", F.lit("build")).alias("node"), end("endfallback.", F.lit("drop")).alias("target")))


def build_actions(diffs: DataFrame) -> DataFrame:
    """Rows of (…, status) with build_type and one row for each action of it: rebuild drops and builds, diff prepares and changes."""
    kind = F.when(F.col("status").isin("none", "diffkids"), "exists").when(F.col("status") == "new", "build").when(F.col("status") == "gone", "drop").otherwise(F.col("status"))
    several = F.when(F.col("build_type") == "rebuild", F.array(F.lit("drop"), F.lit("build"))).when(F.col("build_type") == "diff", F.array(F.lit("diffprep"), F.lit("diff"))).otherwise(F.array("build_type"))
    return diffs.withColumn("build_type", kind).withColumn("action", F.explode(several))


def finalised(actions: DataFrame) -> DataFrame:
    """``build_actions`` whose rows of a rebuild are a drop and a build like any other: their build_type is their action."""
    return actions.withColumn("build_type", F.when(F.col("build_type") == "rebuild", F.col("action")).otherwise(F.col("build_type")))


def pruned(edges: DataFrame, active: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct edges both of whose ends are active."""
    name = active.columns[0]
    return edges.distinct().join(active.select(F.col(name).alias(source)), source, "left_semi").join(active.select(F.col(name).alias(target)), target, "left_semi")


def promoted_rebuilds(diffs: DataFrame, edges: DataFrame) -> DataFrame:
    """Statuses after rebuilds have spread along hard edges (node depends on target): new and gone stay as they are."""
    hard = edges.filter("not soft").select(F.col("target").alias("source"), F.col("node").alias("target"))
    hit = reachable(hard, diffs.filter("status = 'rebuild'").select("node")).withColumn("deltaloom_hit", F.lit(True))
    status = F.when(F.col("deltaloom_hit") & ~F.col("status").isin("new", "gone"), "rebuild").otherwise(F.col("status"))
    return diffs.join(hit, "node", "left").withColumn("status", status).drop("deltaloom_hit")


def plan(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, action, level) in the order of building: what others need comes first; drops run the other way round.

    edges: node depends on target. Any order by (drop first, level, node) is valid.
    """
    needs = edges.select(F.col("target").alias("source"), F.col("node").alias("target"))
    level = levels(actions.select("node"), needs)
    told = met(actions, level, "node")
    return told.withColumn("place", F.when(F.col("action") == "drop", -F.col("level")).otherwise(F.col("level")))
