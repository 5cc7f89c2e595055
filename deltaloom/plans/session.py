"""A stack of DataFrames and the commands that work on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import edges as E
from ..operators import graph as G
from ..operators import tree as T
from ..operators.relational import ranked
from ..sources import catalog
from ..sources import prints, repository
from . import render

#: How objects are compared: among the objects of matched parents by name, by the attributes that ``render`` has statements for; a column's place is no attribute.
OBJECT_RULES = {k: D.Rule(key=("name",), attributes=tuple(D.Attribute(a, rebuild=a in told.rebuild) for a in (*told.changes, *told.rebuild))) for k, told in render.KINDS.items()}


class Session:
    """extract, diff, adddeps, generate, list, print, scatter: each takes its sources from the stack and leaves its result on it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stack = spark, []

    def push(self, df: DataFrame) -> "Session":
        self.stack.append(df)
        return self

    def pop(self) -> DataFrame:
        if not self.stack:
            raise ValueError("the stack is empty")
        return self.stack.pop()

    def result(self) -> DataFrame:
        """The one table left; more are an error."""
        out = self.pop()
        if self.stack:
            raise ValueError(f"{len(self.stack)} tables are left on the stack")
        return out

    def extract(self, tables: dict[str, DataFrame], measured: bool = False) -> "Session":
        return self.push(catalog.describe(self.spark, tables, measured=measured))

    def diff(self, swap: bool = False) -> "Session":
        """Of the two topmost (old below new): objects with status and old_attrs, changes marked on what is above them.

        Objects that are gone carry their old description, all others the new one.
        """
        new, old = self.pop(), self.pop()
        if swap:
            old, new = new, old
        nodes = lambda d: d.select(F.col("fqn").alias("id"), "parent", "type", F.map_concat(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.create_map(F.lit("name"), F.col("name"))).alias("attrs"))
        told = T.statuses(nodes(old), nodes(new), OBJECT_RULES)
        status = told.select(F.coalesce("new_id", "old_id").alias("fqn"), F.col("new_id").isNull().alias("gone"), "status", F.map_filter("old_attrs", lambda k, _: k != "name").alias("old_attrs"))
        sides = new.withColumn("gone", F.lit(False)).unionByName(old.withColumn("gone", F.lit(True)))
        return self.push(sides.join(status, ["fqn", "gone"]).drop("gone"))

    def generate(self, edges: DataFrame | None = None) -> "Session":
        """(seq, fqn, action, text): the statements in the order of dependencies, drops first and the other way round.

        Each object depends on its parent; ``edges`` (node, target) say what else. Objects
        on a cycle of dependencies raise an error. An object that changes has a
        statement for each attribute that does, one that is rebuilt is dropped and built.
        """
        rows = G.build_actions(self.pop()).filter("action in ('build', 'drop', 'diff')")
        needs = rows.select(F.col("fqn").alias("node"), F.col("parent").alias("target")).filter("target is not null")
        if edges is not None:
            needs = needs.unionByName(edges.select("node", "target"))
        placed = G.plan(rows.select(F.col("fqn").alias("node"), "action").distinct(), needs)
        free = F.when(F.col("level").isNull(), F.raise_error(F.concat(F.lit("on or behind a cycle: "), F.col("node"))).cast("int")).otherwise(F.col("place"))
        rows = rows.join(placed.select(F.col("node").alias("fqn"), "action", free.alias("place")), ["fqn", "action"])
        # What goes is told by its old attributes.
        rows = rows.withColumn("attrs", F.when(F.col("action") == "drop", F.coalesce("old_attrs", "attrs")).otherwise(F.col("attrs")))
        lines = render.statements(rows, ["fqn", "action", "place"])
        order = [F.when(F.col("action") == "drop", 0).otherwise(1), F.col("place"), F.col("fqn"), F.col("part")]
        return self.push(ranked(lines, order, "seq").select((F.col("seq") + 1).alias("seq"), "fqn", "action", "text"))

    def list(self, hide: tuple[str, ...] = (), grep: str | None = None) -> "Session":
        """A line for each object, with its status and action where it has them; objects of a status in ``hide`` and those whose fqn does not fit ``grep`` are left out."""
        rows = self.pop()
        if hide and "status" in rows.columns:
            rows = rows.filter(~F.coalesce(F.col("status").isin(*hide), F.lit(False)))
        if grep:
            rows = rows.filter(F.col("fqn").rlike(grep))
        has = lambda c: F.col(c) if c in rows.columns else None
        return self.push(rows.select("fqn", render.listing(F.col("depth"), F.col("type"), F.col("name"), F.col("fqn"), has("status"), has("action")).alias("line")).orderBy("fqn"))

    def adddeps(self, attributes: dict[str, str], without: dict[str, str] | None = None) -> "Session":
        """Leaves the objects and, above them, their dependencies (node, target): on their parents and on what the named attributes say.

        attributes: kind of the target by attribute (``{"owner": "role"}``);
        without: by attribute, the value that names no object.
        """
        objects = self.pop()
        told = objects.select("fqn", "parent", *(F.try_element_at("attrs", F.lit(a)).alias(a) for a in attributes))
        parents = told.select(F.col("fqn").alias("node"), F.col("parent").alias("target")).filter("target is not null")
        return self.push(objects).push(parents.unionByName(E.implied(told, attributes, without=without)).distinct())

    def print(self, path: str, header: list[str] = (), values: dict[str, str] | None = None) -> "Session":
        """Writes the statements (seq, text) or lines (fqn, line) on top as text files in their order, and leaves them there.

        header: as ``prints.filled`` takes it, with ``=>`` for the header of the files that are there.
        """
        rows = self.pop()
        order, text = ("seq", "text") if "seq" in rows.columns else ("fqn", "line")
        head = prints.filled(list(header), values or {}, prints.header_of(self.spark, path))
        prints.write(rows, path, [F.col(order)], text, head)
        return self.push(rows)

    def scatter(self, path: str, by: str = "type", check_only: bool = False) -> "Session":
        """Writes the objects on top to folders that have changed, and leaves what became of each folder (by, status)."""
        return self.push(repository.sync(self.pop(), path, by, check_only))
