"""Moves between consecutive steps of a plan: contexts and places in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_switches(steps: DataFrame, context: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(…, from_context, to_context) for steps whose context differs from the one before; the first step arrives from null.

    keys: plans that are walked one by one. Without keys there is one plan, which is walked in one task.
    """
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return steps.withColumn("from_context", F.lag(context).over(window)).withColumn("to_context", F.col(context)).filter("not (from_context <=> to_context)")


def context_moves(steps: DataFrame, context: str, order: list[str], keys: list[str] | None = None, default: str | None = None) -> DataFrame:
    """(…, move_no, move, context_of): contexts that are left (depart) and entered (arrive) before each step, the old one first.

    The default context, and null, are neither left nor entered: they are where one
    is anyway. The windows are those of ``context_switches``.
    """
    switched = context_switches(steps, context, order, keys)
    told = lambda kind, c: F.when(F.col(c).isNotNull() & (F.lit(default is None) | (F.col(c) != F.lit(default))), F.struct(F.lit(kind).alias("move"), F.col(c).alias("context_of")))
    moves = F.array_compact(F.array(told("depart", "from_context"), told("arrive", "to_context")))
    return switched.select(*steps.columns, F.posexplode(moves).alias("move_no", "deltaloom_move")).select(*steps.columns, "move_no", "deltaloom_move.*")


def common_path(a: Column, b: Column) -> Column:
    """How many leading elements two paths have in common."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(equal, False)
    return F.when(first_off == 0, F.size(equal)).otherwise(first_off - 1).cast("int")


def moves(steps: DataFrame, path: str, order: list[str], keys: list[str] | None = None, action: str | None = None) -> DataFrame:
    """(…, move, at): the nodes departed from, innermost first, and arrived at between each step and the one before.

    action: the column that says what a step does to the last node of its path.
    A node that has been dropped is not departed from, and one that is being
    built is not arrived at; other actions and null change nothing.
    """
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    before = F.coalesce(F.lag(path).over(window), F.array().cast(steps.schema[path].dataType))
    walked = steps.withColumn("deltaloom_before", before).withColumn("deltaloom_shared", F.when(F.size("deltaloom_before") == 0, F.lit(0)).otherwise(common_path(F.col("deltaloom_before"), F.col(path))))
    rest = lambda p: F.slice(p, F.col("deltaloom_shared") + 1, F.greatest(F.size(p) - F.col("deltaloom_shared"), F.lit(0)))
    step = lambda kind: lambda x: F.struct(F.lit(kind).alias("move"), x.alias("at"))
    left, reached = rest(F.col("deltaloom_before")), rest(F.col(path))
    if action:
        without_last = lambda p, hit: F.when(F.coalesce(hit, F.lit(False)) & (F.size(p) > 0), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
        walked = walked.withColumn("deltaloom_did", F.lag(action).over(window))
        left, reached = without_last(left, F.col("deltaloom_did") == "drop"), without_last(reached, F.col(action) == "build")
    all_moves = F.concat(F.transform(F.reverse(left), step("depart")), F.transform(reached, step("arrive")))
    return walked.select(*steps.columns, F.posexplode(all_moves).alias("move_no", "deltaloom_move")).select(*steps.columns, "move_no", "deltaloom_move.*")


def flattened(objects: DataFrame, parent: str = "parent", fqn: str = "fqn") -> DataFrame:
    """``objects`` with parent_node, a struct of the parent's columns (null without one), found by its fqn.

    An fqn that several objects have is an error where an object names it as its parent.
    """
    parents = objects.groupBy(F.col(fqn).alias("deltaloom_fqn")).agg(F.count("*").alias("deltaloom_many"), F.first(F.struct(*objects.columns)).alias("deltaloom_node"))
    joined = objects.join(parents, F.col(parent) == F.col("deltaloom_fqn"), "left")
    several = F.raise_error(F.concat(F.lit("several objects are called "), F.col("deltaloom_fqn").cast("string")))
    return joined.withColumn("parent_node", F.when(F.col("deltaloom_many") > 1, several).otherwise(F.col("deltaloom_node"))).drop("deltaloom_fqn", "deltaloom_many", "deltaloom_node")


def steps(nodes: DataFrame, order: str, within: list[str], fqn: str = "fqn", disabled: str = "disabled") -> DataFrame:
    """(within..., from_fqn, fqn): each enabled node with the enabled one before it; the first has none.

    Rows where ``disabled`` is true are left out. One window for each value of ``within``.
    """
    on = nodes.filter(~F.coalesce(F.col(disabled), F.lit(False)))
    return on.select(*within, F.lag(fqn).over(Window.partitionBy(*within).orderBy(order, fqn)).alias("from_fqn"), fqn)


def without_prints(objects: DataFrame, prints: DataFrame, fqn: str = "fqn", condition: str = "condition", disabled: str = "disabled") -> DataFrame:
    """``objects`` with the column ``disabled``: true for those that have no print without a condition.

    prints: (fqn, condition); they are counted by object before they meet the objects.
    """
    always = prints.groupBy(fqn).agg(F.bool_or(F.col(condition).isNull()).alias("deltaloom_always"))
    return objects.join(always, fqn, "left").withColumn(disabled, ~F.coalesce("deltaloom_always", F.lit(False))).drop("deltaloom_always")
