"""Sets of dependencies: nested ones laid flat, fallbacks that serve several sets, choices that are taken back, mirrors and nodes taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cycles, kept, met, plan, released, without_cycles


def flattened(parts: DataFrame) -> DataFrame:
    """(node, depset_id, name, is_full, applies, direction, conditions, rank): the dependencies of nested groups and sets, one row each.

    parts: (id, parent, node, kind, place, fqn, pqn, applies, direction,
    condition, priority); kind is ``dependencies`` (a group), ``set`` or
    ``dependency``, the parent of an outermost part is null. applies and
    direction are those of the innermost part around a dependency, itself
    included, that says them; all conditions on the way down must hold.
    depset_id is the outermost set around it, null outside any set: the options
    of a set within a set are options of the outer one, in its place. rank, an
    array of (priority, place) from the set inwards (priority null: 100), puts
    the options of a set in order. A dependency with neither fqn nor pqn raises an
    error, and so does another kind; children of a dependency, and parts that
    hang on nothing, are not reached. Rounds are as many as parts are nested,
    each one a join of the level above with all parts.
    """
    known = F.col("kind").isin("dependencies", "set", "dependency")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no kind of dependency: "), F.coalesce("kind", F.lit("<null>")))).cast("string"))
    own = F.struct(F.coalesce("priority", F.lit(100)).cast("long").alias("priority"), F.col("place").cast("long").alias("place"))
    parts = kept(parts.select("id", "parent", "node", kind.alias("kind"), "fqn", "pqn", F.lower("applies").alias("applies"), F.lower("direction").alias("direction"), "condition", own.alias("own")))
    nothing = F.array().cast("array<string>")
    told = lambda c: F.array_compact(F.array(c))
    is_set = F.col("kind") == "set"
    level = parts.filter("parent is null").select("id", "node", "kind", "fqn", "pqn", "applies", "direction", told(F.col("condition")).alias("conditions"), F.when(is_set, F.col("id")).alias("depset_id"), F.array().cast(f"array<{parts.schema['own'].dataType.simpleString()}>").alias("rank"))
    found = []
    while True:
        level = kept(level)
        found.append(level)
        around = level.filter("kind <> 'dependency'").select(F.col("id").alias("parent"), F.col("node").alias("of"), *(F.col(c).alias(f"around_{c}") for c in ("applies", "direction", "conditions", "depset_id", "rank")))
        below = parts.join(around, "parent")
        inside = F.col("around_depset_id").isNotNull()
        level = below.select("id", F.col("of").alias("node"), "kind", "fqn", "pqn", F.coalesce("applies", "around_applies").alias("applies"), F.coalesce("direction", "around_direction").alias("direction"), F.concat("around_conditions", F.coalesce(told(F.col("condition")), nothing)).alias("conditions"), F.coalesce("around_depset_id", F.when(is_set, F.col("id"))).alias("depset_id"), F.when(inside, F.concat("around_rank", F.array("own"))).otherwise(F.col("around_rank")).alias("rank"))
        if not below.limit(1).count():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    name = F.coalesce("fqn", "pqn", F.raise_error(F.concat(F.lit("no name in a dependency of "), F.col("node").cast("string"))).cast("string"))
    return out.filter("kind = 'dependency'").select("node", "depset_id", name.alias("name"), F.col("fqn").isNotNull().alias("is_full"), "applies", "direction", "conditions", "rank")


def chosen(options: DataFrame, existing: DataFrame, holding: DataFrame) -> DataFrame:
    """Of ``flattened`` rows the plain dependencies, and of each set the first option, that exist and whose conditions hold.

    existing: (name). holding: (condition). Rows keep their columns; a plain
    dependency that does not exist stays, for ``resolved`` to judge.
    """
    row = options.withColumn("deltaloom_row", F.monotonically_increasing_id())
    row = kept(row)
    asked = row.select("deltaloom_row", F.explode(F.array_distinct("conditions")).alias("condition"))
    failed = asked.join(holding.select("condition").distinct(), "condition", "left_anti").select("deltaloom_row").distinct()
    there = existing.select(F.col(existing.columns[0]).alias("name")).distinct().withColumn("deltaloom_there", F.lit(True))
    live = row.join(failed, "deltaloom_row", "left_anti").join(there, "name", "left")
    sets = live.filter("depset_id is not null and deltaloom_there")
    first = sets.withColumn("deltaloom_n", F.row_number().over(Window.partitionBy("node", "depset_id").orderBy("rank", "name"))).filter("deltaloom_n = 1")
    return live.filter("depset_id is null").unionByName(first.drop("deltaloom_n")).select(*options.columns)


def selectable(options: DataFrame, existing: DataFrame) -> DataFrame:
    """(depset_id, options, selectable): how many options each set has and how many of them exist. options: (depset_id, name); existing: (name)."""
    there = existing.select(F.col(existing.columns[0]).alias("name")).distinct().withColumn("deltaloom_there", F.lit(True))
    return options.join(there, "name", "left").groupBy("depset_id").agg(F.count("*").alias("options"), F.count_if(F.coalesce("deltaloom_there", F.lit(False))).alias("selectable"))


def shared_fallbacks(sets: DataFrame) -> DataFrame:
    """(depset_id, fallback, own): for sets without a candidate, taken in order, the fallback that each uses.

    sets: (depset_id, side, priority, names, fallback), those that nothing was
    found for. They are taken by priority (null: 100), then id. A set uses the
    first fallback made before it on its side whose name begins with one of
    ``names``, or is its own ``fallback``; without one it makes its own (own is
    true), and without a fallback to make it raises an error.

    Sets wait only for those before them that might serve them. A round settles
    all that wait for nothing, in one job over the first set of each fallback's
    name that is still open, so rounds follow the longest chain of sets that
    might serve each other, not their number. A fallback is known by all the
    beginnings of its name: the join on them is one of equal keys.
    """
    order = F.struct(F.coalesce("priority", F.lit(100)).alias("priority"), F.col("depset_id").alias("id"))
    named = F.coalesce("fallback", F.raise_error(F.concat(F.lit("no candidate and no fallback: "), F.col("depset_id").cast("string"))).cast("string"))
    # Its own name stands apart from names: it must be equal, not just begin so.
    keys = F.array_union(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("^"), n)), F.array(F.concat(F.lit("="), F.col("fallback"))))
    open_ = kept(sets.select("depset_id", "side", order.alias("order"), keys.alias("keys"), named.alias("fallback")))
    begins = F.concat(F.transform(F.sequence(F.lit(0), F.length("fallback")), lambda n: F.concat(F.lit("^"), F.col("fallback").substr(F.lit(1), n))), F.array(F.concat(F.lit("="), F.col("fallback"))))
    made, done = None, []
    while open_.limit(1).count():
        first = open_.groupBy("side", "fallback").agg(F.min("order").alias("from"))
        servers = first.withColumn("made", F.lit(False)).unionByName(made.withColumn("made", F.lit(True))) if made is not None else first.withColumn("made", F.lit(False))
        servers = servers.select("side", "from", "made", "fallback", F.explode(begins).alias("key")).withColumnRenamed("fallback", "by")
        asked = open_.select("depset_id", "side", "order", F.explode("keys").alias("key")).join(servers, ["side", "key"]).filter(F.col("from") < F.col("order"))
        served = asked.groupBy("depset_id").agg(F.min(F.when(F.col("made"), F.struct("from", "by"))).alias("server"), F.min(F.when(~F.col("made"), F.col("from"))).alias("waits"))
        state = open_.join(served, "depset_id", "left")
        # A set is settled once nothing open stands before the one that serves it.
        settled = F.col("waits").isNull() | (F.col("server.from") < F.col("waits"))
        state = kept(state.withColumn("settled", F.coalesce(settled, F.lit(False))))
        now = kept(state.filter("settled").select("depset_id", "side", "order", F.coalesce("server.by", "fallback").alias("fallback"), F.col("server").isNull().alias("own")))
        done.append(now)
        fresh = now.filter("own").groupBy("side", "fallback").agg(F.min("order").alias("from"))
        made = kept(fresh if made is None else made.unionByName(fresh))
        open_ = kept(state.filter("not settled").select(*open_.columns))
    out = sets.select("depset_id", F.lit("").alias("fallback"), F.lit(True).alias("own")).limit(0)
    for more in done:
        out = out.unionByName(more.select("depset_id", "fallback", "own"))
    return out


def acyclic_choice(edges: DataFrame, options: DataFrame, breakers: DataFrame) -> DataFrame:
    """(node, target, depset_id) as of ``graph.without_cycles``, but with choices that are taken back.

    edges: (node, target); options: (depset_id, node, target, priority);
    breakers: (node, breaker). Of all ways to choose one option of each set the
    first without a cycle is taken, in the order of the sets' ids and of their
    options' priorities, the choice of the last set moving first. Only where no
    choice is without a cycle do breakers stand in (``without_cycles``), and
    where they don't help either an error is raised.

    Cycles lie within the components of the graph of all options, and these are
    searched apart from each other, all of them in one job a round. A round
    drops every choice that shares the sets up to the last one on some cycle of
    the present choice, so it skips much and loses nothing. Rounds are bounded
    by the ways to choose within a component, which can be many for many sets;
    rows stay as many as edges and options.
    """
    spot = Window.partitionBy("depset_id").orderBy("priority", "target")
    ranked = kept(options.select("node", "target", "depset_id", F.row_number().over(spot).alias("place"), F.count("*").over(Window.partitionBy("depset_id")).cast("int").alias("of")))
    every = edges.select("node", "target").unionByName(ranked.select("node", "target"))
    component = kept(cycles(every, "node", "target").select("node", F.col("cycle").alias("component")))
    to = component.withColumnsRenamed({"node": "target", "component": "to"})
    inside = lambda d: d.join(component, "node").join(to, "target").filter("component = to").drop("to")
    fixed = kept(inside(edges.select("node", "target")).distinct())
    within = kept(inside(ranked))
    # Sets with an option within a component, numbered there; the rest takes its first option and stays out of the search.
    sets = within.select("component", "depset_id", "of").distinct()
    state = kept(sets.withColumns({"number": F.row_number().over(Window.partitionBy("component").orderBy("depset_id")), "place": F.lit(1)}).withColumn("over", F.lit(False)))
    while True:
        taken = state.filter("not over").join(within.drop("of"), ["component", "depset_id", "place"]).select("component", "node", "target", "number")
        fixed_now = fixed.join(state.filter("over").select("component").distinct(), "component", "left_anti")
        now = kept(taken.unionByName(fixed_now.withColumn("number", F.lit(0)), True))
        on = kept(cycles(now, "node", "target"))
        if not on.limit(1).count():
            break
        ends = on.withColumnsRenamed({"node": "target", "cycle": "to"})
        last = now.join(on, "node").join(ends, "target").filter("cycle = to").groupBy("component", "cycle").agg(F.max("number").alias("last")).groupBy("component").agg(F.min("last").alias("last"))
        turn = state.join(last, "component").filter("number <= last and place < of").groupBy("component").agg(F.max("number").alias("turn"))
        told = state.join(last, "component", "left").join(turn, "component", "left")
        place = F.when(F.col("last").isNull() | (F.col("number") < F.col("turn")), F.col("place")).when(F.col("number") == F.col("turn"), F.col("place") + 1).otherwise(1)
        over = F.col("over") | (F.col("last").isNotNull() & F.col("turn").isNull())
        bare = kept(last.join(state.select("component").distinct(), "component", "left_anti"))
        before = state
        state = kept(told.select("component", "depset_id", "of", "number", place.alias("place"), over.alias("over")))
        # Components without a set, whose cycles only breakers can mend.
        fixed = kept(fixed.join(bare.select("component"), "component", "left_anti"))
        released(before, now)
    settled = state.filter("not over").select("depset_id", F.col("place").alias("settled"))
    free = ranked.join(settled, "depset_id", "left").filter("settled is null or settled = place").drop("settled")
    # What is settled has one option left; where the search found none, all are open to the breakers' way.
    return without_cycles(edges, free.select("depset_id", "node", "target", F.col("place").alias("priority")), breakers)


def propagated_mirrors(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, action, after_node, after_action): what is built or changed waits for the drop or preparation of those that inherit from it.

    actions: (node, action). edges: (node, target, propagate), node needs
    target. From each node that is both dropped and built, or prepared and
    changed, its first half goes before the build or change of every node that
    edges with ``propagate`` lead to, at any distance. Rounds follow the depth of
    inheritance; a pair is kept once, and cycles end by themselves.
    """
    way = kept(edges.filter(F.coalesce("propagate", F.lit(False))).select("node", "target").filter("node <> target").distinct())
    has = actions.groupBy("node").agg(F.collect_set("action").alias("has"))
    first = F.when(F.array_contains("has", "drop") & F.array_contains("has", "build"), "drop").when(F.array_contains("has", "diffprep") & F.array_contains("has", "diff"), "diffprep")
    starts = has.select(F.col("node").alias("from"), first.alias("after_action")).filter("after_action is not null")
    pairs = kept(starts.join(way, F.col("from") == F.col("node")).select("from", "after_action", F.col("target").alias("node")).distinct())
    found, frontier = pairs, pairs
    while frontier.limit(1).count():
        further = frontier.join(way, "node").select("from", "after_action", F.col("target").alias("node")).filter("node <> from").distinct()
        frontier = kept(further.join(found.select("from", "node"), ["from", "node"], "left_anti"))
        found = found.unionByName(frontier)
    waits = actions.filter("action in ('build', 'diff')").select("node", "action").distinct()
    return found.join(waits, "node").select("node", "action", F.col("from").alias("after_node"), "after_action")


def contracted(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(node, target): the edges between nodes that stay, and one for each way between two of them over removed nodes alone.

    edges: node needs target. removed: (node). What a way over removed nodes puts
    in order stays in order; an edge of a node to itself is left out. Ways double
    in each round, so rounds are the logarithm of the longest chain of removed
    nodes.
    """
    gone = kept(removed.select(F.col(removed.columns[0]).alias("node")).distinct())
    to_gone = gone.withColumnRenamed("node", "target")
    arrows = kept(edges.select("node", "target").filter("node is not null and target is not null and node <> target").distinct())
    leaving = kept(met(met(arrows, gone, "node", "left_semi"), to_gone, "target", "left_anti").select("node", "target"))
    ways = kept(met(met(arrows, gone, "node", "left_semi"), to_gone, "target", "left_semi").select("node", "target"))
    known = ways.count()
    while known:
        twice = met(ways, ways.select(F.col("node").alias("target"), F.col("target").alias("next")), "target").select("node", F.col("next").alias("target")).filter("node <> target")
        longer = kept(ways.unionByName(twice).distinct())
        count = longer.count()
        released(ways)
        ways = longer
        if count == known:
            break
        known = count
    out = leaving.unionByName(met(ways.withColumnRenamed("target", "via"), leaving.withColumnRenamed("node", "via"), "via").select("node", "target")).distinct()
    stay = met(arrows, gone, "node", "left_anti")
    direct = met(stay, to_gone, "target", "left_anti").select("node", "target")
    bridged = met(stay.withColumnRenamed("target", "via"), out.withColumnRenamed("node", "via"), "via").select("node", "target").filter("node <> target")
    return direct.unionByName(bridged).distinct()


def plan_of_printed(actions: DataFrame, edges: DataFrame, silent: DataFrame) -> DataFrame:
    """``graph.plan`` without what prints nothing: (node, action, level, place).

    actions: (node, action); edges: node needs target; silent: (node), those
    whose statements are empty. A silent node on a cycle stops needing anything,
    as it has nothing to wait with, so that its cycles are broken; the order
    over all other silent nodes is kept by ``contracted``. Then silent nodes are
    taken out. Nodes on cycles of printing nodes keep a null level.
    """
    quiet = kept(silent.select(F.col(silent.columns[0]).alias("node")).distinct())
    ring = cycles(edges.select("node", "target"), "node", "target")
    idle = met(ring.select("node"), quiet, "node", "left_semi")
    needs = kept(met(edges.select("node", "target"), idle, "node", "left_anti"))
    left = met(actions, quiet, "node", "left_anti")
    return plan(left, contracted(needs, quiet))
