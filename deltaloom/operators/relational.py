"""Joins, lookups, grouping and recursion that the catalogue queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_lookup(rows: DataFrame, table: DataFrame, on: Column, key: str) -> DataFrame:
    """Left join to a table whose non-null ``key`` must be unique; a repeated key raises when the rows are read."""
    kept = table.filter(F.col(key).isNotNull())
    many = F.count("*").over(Window.partitionBy(key)) > 1
    checked = kept.withColumn(key, F.when(many, F.raise_error(F.concat(F.lit("key is not unique: "), F.col(key).cast("string"))).cast(kept.schema[key].dataType)).otherwise(F.col(key)))
    return rows.join(checked, on, "left")


def any_key_join(left: DataFrame, right: DataFrame, left_key: str, right_keys: list[str]) -> DataFrame:
    """Inner join on left_key equal to any of right_keys: one equi-join on the distinct keys, in place of an OR."""
    keyed = right.withColumn("deltaloom_key", F.explode(F.array_distinct(F.array_compact(F.array(*right_keys)))))
    return left.join(keyed, F.col(left_key) == F.col("deltaloom_key")).drop("deltaloom_key")


def nested(parents: DataFrame, children: DataFrame, on: list[str], name: str, order: list[str]) -> DataFrame:
    """Each parent with the array of its children, in order; empty where it has none."""
    fields = [c for c in children.columns if c not in on]
    ordered = [*order, *(f for f in fields if f not in order)]
    grouped = children.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*ordered))).alias(name))
    return parents.join(grouped, on, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def member_routes(classes: DataFrame, members: DataFrame, class_key: str, family_key: str) -> DataFrame:
    """Members by their class key; those without one by their family key. A column ``route`` says which."""
    told = [c for c in members.columns if c not in (class_key, family_key)]
    direct = classes.join(members.drop(family_key), class_key).withColumn("route", F.lit("class"))
    loose = members.filter(F.col(class_key).isNull()).drop(class_key)
    by_family = classes.join(loose, family_key).withColumn("route", F.lit("family"))
    columns = [*classes.columns, *told, "route"]
    return direct.select(*columns).unionByName(by_family.select(*columns))


def last_before(rows: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null ``value`` in a row before this one."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "index") -> DataFrame:
    """Rows with their place among those of the same ``keys``, from 1. Filters come after it, so that a row left out has a number, too."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def nested_where(parents: DataFrame, children: DataFrame, flag: str, on: list[str], name: str, order: list[str]) -> DataFrame:
    """``nested`` with the children for which ``flag`` is true, such as the inherited columns of a table."""
    return nested(parents, children.filter(F.col(flag)).drop(flag), on, name, order)


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place in ``order``, from 0, without one task for all.

    Ranges of the order are sorted one by one; a range starts after the counts of
    those before, which alone pass through one window, a row a range. What
    ``order`` leaves open is not defined.
    """
    from .graph import kept

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("deltaloom_id", F.monotonically_increasing_id())
    placed = kept(placed)
    part, at = F.shiftright("deltaloom_id", 33), F.col("deltaloom_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("deltaloom_part")).agg(F.count("*").alias("deltaloom_n"))
    before = F.coalesce(F.sum("deltaloom_n").over(Window.orderBy("deltaloom_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("deltaloom_part", before.alias("deltaloom_before"))
    return placed.withColumn("deltaloom_part", part).join(F.broadcast(starts), "deltaloom_part").select(*rows.columns, (F.col("deltaloom_before") + at).cast("long").alias(name))
