"""Trees of objects as rows (id, parent, type, attrs): matching, statuses, rebuilds, hashes, inherited columns.

attrs is a map of texts; the parent of a root is null. Rounds go level by level,
so they are as many as the tree is deep, whatever its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diff import Rule
from .graph import kept, reachable, released
from .relational import ranked


def _lookup(entries: dict[str, Column], key: Column) -> Column | None:
    return F.try_element_at(F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v))), key) if entries else None


def _keyed(nodes: DataFrame, rules: dict[str, Rule], default: str) -> DataFrame:
    """(id, parent, type, key): key is the JSON array of the attributes that the type's rule names, else of ``default``; one that is missing raises."""
    names = _lookup({t: F.array(*map(F.lit, r.key)) for t, r in rules.items()}, F.col("type"))
    names = F.array(F.lit(default)) if names is None else F.coalesce(names, F.array(F.lit(default)))
    values = F.transform(names, lambda n: F.coalesce(F.try_element_at("attrs", n), F.raise_error(F.concat(F.lit("no key "), n, F.lit(" in "), F.col("id").cast("string"))).cast("string")))
    return nodes.select("id", "parent", "type", F.to_json(values).alias("key"))


def _once(keyed: DataFrame) -> DataFrame:
    twice = keyed.groupBy("parent", "type", "key").agg(F.count("*").alias("n")).filter("n > 1").select("type", "key").first()
    if twice:
        raise ValueError(f"several siblings are {twice.type} {twice.key}")
    return keyed


def matched(old: DataFrame, new: DataFrame, rules: dict[str, Rule], default: str = "fqn") -> DataFrame:
    """(old_id, new_id): nodes of one type and key among the children of matched parents; roots match roots.

    A node that has moved to another parent matches nothing, and neither does
    anything below it. Two siblings of one type and key raise an error, and so
    does a node without its key. A round is two joins on the pairs of the level
    above; pairs of the levels are kept, the keyed nodes are released.
    """
    a, b = (_once(kept(_keyed(d, rules, default))) for d in (old, new))
    same = ["type", "key"]
    pairs = kept(a.filter("parent is null").join(b.filter("parent is null").select(F.col("id").alias("new_id"), *same), same).select(F.col("id").alias("old_id"), "new_id"))
    found = [pairs]
    while pairs.limit(1).count():
        below = b.join(pairs, b["parent"] == pairs["new_id"]).select(F.col("old_id").alias("parent"), *same, F.col("id").alias("below_id"))
        pairs = kept(a.join(below, ["parent", *same]).select(F.col("id").alias("old_id"), F.col("below_id").alias("new_id")))
        found.append(pairs)
    released(a, b)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def statuses(old: DataFrame, new: DataFrame, rules: dict[str, Rule], default: str = "fqn", strict: bool = False) -> DataFrame:
    """(node, parent, type, status, old_id, new_id, old_attrs, new_attrs), one row for each node of either tree.

    node is ``new:<id>``, or ``old:<id>`` of one that is gone; parent likewise.
    What matches nothing is new or gone, with all that is below it. A matched
    node is rebuild or diff by the attributes and texts of its type's rule
    (a ``fail`` attribute raises), else UNKNOWN if its type has no rule, else
    diffkids if anything below it is not none, else none. Nodes that are gone
    count for their parents only if ``strict``.
    """
    pairs = kept(matched(old, new, rules, default))
    told = lambda d, side: d.select(F.col("id").alias(f"{side}_id"), F.col("parent").alias(f"{side}_parent"), F.col("type").alias(f"{side}_type"), F.col("attrs").alias(f"{side}_attrs"))
    both = told(old, "old").join(pairs, "old_id", "left")
    both = both.filter("new_id is not null").join(told(new, "new"), "new_id").unionByName(both.filter("new_id is null"), True)
    both = both.unionByName(told(new, "new").join(pairs, "new_id", "left_anti"), True)

    def differs(wanted: dict[str, tuple[str, ...]], text: bool = False) -> Column:
        names = _lookup({t: F.array(*map(F.lit, n)) for t, n in wanted.items() if n}, F.col("new_type"))
        if names is None:
            return F.lit(False)
        side = lambda s, n: F.coalesce(F.try_element_at(f"{s}_attrs", n), F.lit("")) if text else F.try_element_at(f"{s}_attrs", n)
        return F.coalesce(F.exists(names, lambda n: ~side("old", n).eqNullSafe(side("new", n))), F.lit(False))

    rebuilt = differs({t: tuple(a.name for a in r.attributes if a.rebuild or r.rebuild) for t, r in rules.items()}) | differs({t: r.texts for t, r in rules.items() if r.rebuild}, True)
    changed = differs({t: tuple(a.name for a in r.attributes) for t, r in rules.items()}) | differs({t: r.texts for t, r in rules.items()}, True)
    of_rule = F.col("new_type").isin(*rules) if rules else F.lit(False)
    status = F.when(F.col("old_id").isNull(), "new").when(F.col("new_id").isNull(), "gone").when(rebuilt, "rebuild").when(changed, "diff").when(~of_rule, "UNKNOWN").otherwise("none")
    for kind, rule in rules.items():
        for a in rule.attributes:
            if a.fail:
                sides = [F.try_element_at(f"{s}_attrs", F.lit(a.name)) for s in ("old", "new")]
                wrong = (F.col("old_type") == kind) & F.col("new_id").isNotNull() & ~sides[0].eqNullSafe(sides[1])
                status = F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit(a.fail), *(F.coalesce(s, F.lit("<null>")) for s in sides))).cast("string")).otherwise(status)
    name = lambda side, c: F.concat(F.lit(f"{side}:"), F.col(c).cast("string"))
    # The parent of one that is gone is found among the pairs.
    above = pairs.select(F.col("old_id").alias("old_parent"), F.col("new_id").alias("parent_now"))
    rows = both.withColumn("status", status).join(above, "old_parent", "left")
    parent = F.when(F.col("new_id").isNotNull(), name("new", "new_parent")).otherwise(F.coalesce(name("new", "parent_now"), name("old", "old_parent")))
    rows = kept(rows.select(F.coalesce(name("new", "new_id"), name("old", "old_id")).alias("node"), parent.alias("parent"), F.coalesce("new_type", "old_type").alias("type"), "status", "old_id", "new_id", "old_attrs", "new_attrs"))
    released(pairs)
    counts = F.col("status").isin("new", "diff", "rebuild", "UNKNOWN", *(["gone"] if strict else []))
    return _marked_above(rows, rows.filter(counts))


def _marked_above(rows: DataFrame, seeds: DataFrame, stop: bool = False) -> DataFrame:
    """``rows`` with diffkids in place of none for what is above ``seeds``; with ``stop`` only up to the first that is not none."""
    up = rows.select("node", "parent").filter("parent is not null")
    if stop:
        up = up.join(rows.filter("status = 'none'").select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    start = seeds.select(F.col("parent").alias("node")).filter("node is not null")
    if stop:
        start = start.join(rows.filter("status = 'none'").select("node"), "node", "left_semi")
    hit = reachable(up, start, "node", "parent").withColumn("deltaloom_hit", F.lit(True))
    status = F.when(F.col("deltaloom_hit") & (F.col("status") == "none"), "diffkids").otherwise(F.col("status"))
    return rows.join(hit, "node", "left").withColumn("status", status).drop("deltaloom_hit").select(*rows.columns)


def promoted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node, parent, status, follow, …) after rebuilds have spread.

    edges: (node, target, soft). A node is made anew if one that it needs, not
    softly, or the one that it follows is; new and gone nodes keep their status
    but pass it on. Above a node that has become rebuild, parents of status none
    become diffkids, up to the first that has another status. Cycles end by
    themselves. Two searches: one against the needs, one up the tree.
    """
    follows = nodes.filter("follow is not null").select("node", F.col("follow").alias("target"))
    against = edges.filter(~F.coalesce(F.col("soft"), F.lit(False))).select("node", "target").unionByName(follows)
    hit = kept(reachable(against, nodes.filter("status = 'rebuild'").select("node"), "target", "node").withColumn("deltaloom_hit", F.lit(True)))
    fresh = F.col("deltaloom_hit") & ~F.col("status").isin("new", "gone", "rebuild")
    rows = kept(nodes.join(hit, "node", "left").withColumn("deltaloom_fresh", F.coalesce(fresh, F.lit(False))).withColumn("status", F.when(F.col("deltaloom_fresh"), "rebuild").otherwise(F.col("status"))).drop("deltaloom_hit"))
    return _marked_above(rows, rows.filter("deltaloom_fresh"), stop=True).select(*nodes.columns)


def hashes(nodes: DataFrame) -> DataFrame:
    """(id, hash, size) of each subtree of ``nodes`` (id, parent, type, attrs, place, text).

    Two subtrees have one hash if their types, attributes (in any order), texts
    (without the white space around them, null as empty) and children in the
    order of ``place`` agree, at every depth; places need not be the same numbers.
    size: nodes in the subtree. From the leaves up, a round a level; a parent's
    children are added up, not collected, so a node may have any number of them:
    the hash of a child is taken with its number among its siblings, and sums of
    two 64-bit hashes of that pair stand for all. A cycle in ``parent`` raises.
    """
    attrs = F.to_json(F.array_sort(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>")))))
    own = F.sha2(F.to_json(F.array(F.col("type"), attrs, F.coalesce(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("")))), 256)
    # A node's number among its siblings is its place among all, less that of the first of them.
    placed = ranked(nodes.select("id", "parent", "place", own.alias("own")), [F.col("parent"), F.col("place"), F.col("id")], "at")
    first = placed.groupBy(F.col("parent").alias("of")).agg(F.min("at").alias("first"))
    left = kept(placed.join(first, F.col("parent").eqNullSafe(F.col("of"))).select("id", "parent", "own", (F.col("at") - F.col("first")).alias("nth")))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = None
    done = []
    # Children that wait for their sums; a node is ready when none of them is left.
    waiting = kept(left.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("wait")))
    while left.limit(1).count():
        ready = left.join(waiting, "id", "left_anti")
        if sums is not None:
            ready = ready.join(sums, "id", "left")
        else:
            ready = ready.withColumns({"a": zero, "b": zero, "size": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
        told = F.when(F.coalesce("n", F.lit(0)) == 0, F.col("own")).otherwise(F.sha2(F.concat_ws("|", "own", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256))
        ready = kept(ready.select("id", "parent", "nth", told.alias("hash"), (F.coalesce("size", F.lit(0)) + 1).alias("size")))
        if not ready.limit(1).count():
            raise ValueError("parents lead round in a circle")
        done.append(ready)
        pair = lambda salt: F.xxhash64(F.lit(salt), "nth", "hash").cast("decimal(38,0)")
        fresh = ready.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum(pair(1)).cast("decimal(38,0)").alias("a"), F.sum(pair(2)).cast("decimal(38,0)").alias("b"), F.sum("size").alias("size"), F.count("*").alias("n"))
        if sums is not None:
            fresh = sums.unionByName(fresh).groupBy("id").agg(F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"), F.sum("size").alias("size"), F.sum("n").alias("n"))
        fresh, before = kept(fresh), (sums, left, waiting)
        came = ready.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("came"))
        waiting = kept(waiting.join(came, "id", "left").select("id", (F.col("wait") - F.coalesce("came", F.lit(0))).alias("wait")).filter("wait > 0"))
        left = kept(left.join(ready.select("id"), "id", "left_anti"))
        sums = fresh
        released(*before)
    released(left, sums, waiting)
    out = nodes.select("id").withColumns({"hash": F.lit(""), "size": F.lit(0).cast("long")}).limit(0)
    for more in done:
        out = out.unionByName(more.select("id", "hash", "size"))
    return out


def equal_subtrees(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key..., status): UNCHANGED, MODIFIED, NEW or OLD for the objects whose roots have the columns ``key`` beside those of ``hashes``.

    An object counts as a whole: with all that is below it.
    """
    a, b = (d.select("id", *key).join(hashes(d), "id").filter(" and ".join(f"{k} is not null" for k in key)).select(*key, F.col("hash").alias(s)) for d, s in ((old, "was"), (new, "is")))
    status = F.when(F.col("was").isNull(), "NEW").when(F.col("is").isNull(), "OLD").when(F.col("was") == F.col("is"), "UNCHANGED").otherwise("MODIFIED")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def inherited(columns: DataFrame, tables: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``columns`` (table, column, status, is_local) after a comparison, with their table's status and what they inherit.

    tables: (table, status). old, new: (table, column, from_table), the columns
    that a table had and has from others. parent_status is the table's;
    inherits an array of (from_table, change, column_status), in order: change
    is ``disinherit`` where only the old side has the table inherit from the
    other, ``inherit`` where only the new one has, null for both;
    column_status is the other column's, none where it went with its whole
    table, as then nothing is dropped from this one. Columns that are local
    alone inherit nothing. Old and new edges are set against each other in one
    grouping; no row is lost where the other column is unknown (null).
    """
    sides = old.select("table", "column", "from_table", F.lit(True).alias("was"), F.lit(False).alias("is")).unionByName(new.select("table", "column", "from_table", F.lit(False).alias("was"), F.lit(True).alias("is")))
    by_table = sides.groupBy("table", "from_table").agg(F.bool_or("was").alias("table_was"), F.bool_or("is").alias("table_is"))
    edges = sides.select("table", "column", "from_table").distinct().join(by_table, ["table", "from_table"])
    of_table = tables.select(F.col("table").alias("from_table"), F.col("status").alias("from_status"))
    of_column = columns.select(F.col("table").alias("from_table"), "column", F.col("status").alias("other"))
    edges = edges.join(of_table, "from_table", "left").join(of_column, ["from_table", "column"], "left")
    change = F.when(~F.col("table_is"), "disinherit").when(~F.col("table_was"), "inherit")
    other = F.when((F.col("other") == "gone") & (F.col("from_status") == "gone"), "none").otherwise(F.col("other"))
    summed = edges.groupBy("table", "column").agg(F.sort_array(F.collect_list(F.struct("from_table", change.alias("change"), other.alias("column_status")))).alias("inherits"))
    out = columns.join(tables.select("table", F.col("status").alias("parent_status")), "table", "left").join(summed, ["table", "column"], "left")
    nothing = F.array().cast(summed.schema["inherits"].dataType)
    return out.withColumn("inherits", F.when(F.coalesce(F.col("is_local"), F.lit(False)), nothing).otherwise(F.coalesce("inherits", nothing))).select(*columns.columns, "parent_status", "inherits")
