"""Edges between objects: those their attributes imply, the side they apply to, conditions, mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def implied(objects: DataFrame, attributes: dict[str, str], fqn: str = "fqn", without: dict[str, str] | None = None) -> DataFrame:
    """(node, target): an edge from each object to the object that each of its attributes names.

    attributes: kind of the target by column (``{"owner": "role"}`` gives
    ``role.<owner>``). without: by column, the value that names no object
    (``{"owner": "public"}``). Null attributes give no edge. One pass over the
    objects, no shuffle.
    """
    named = [F.when(F.coalesce(F.col(c) != F.lit((without or {}).get(c)), F.col(c).isNotNull()), F.concat(F.lit(f"{kind}."), F.col(c).cast("string"))) for c, kind in attributes.items()]
    return objects.select(F.col(fqn).alias("node"), F.explode(F.array_compact(F.array(*named))).alias("target"))


def stripped(objects: DataFrame, added: list[str], retain: str | None = None) -> DataFrame:
    """``objects`` without the values of the ``added`` columns, except where the column ``retain`` is true."""
    keep = F.coalesce(F.col(retain), F.lit(False)) if retain else F.lit(False)
    return objects.select(*(F.when(keep, F.col(c)).alias(c) if c in added else F.col(c) for c in objects.columns))


def conditional(edges: DataFrame, objects: DataFrame, condition: Column, needs: str = "needs", fqn: str = "fqn") -> DataFrame:
    """Edges whose column ``needs`` is null, or names an object for which ``condition`` holds (a semi-join)."""
    fits = objects.filter(condition).select(F.col(fqn).alias(needs)).distinct()
    return edges.filter(F.col(needs).isNull()).unionByName(edges.filter(F.col(needs).isNotNull()).join(fits, needs, "left_semi").select(*edges.columns))


def sided(edges: DataFrame, applies: str = "applies", direction: str = "direction") -> DataFrame:
    """(node, target, side): each edge on the sides it applies to, the drop side turned round.

    applies: ``forwards`` (build side), ``backwards`` (drop side), null for both.
    direction overrides the side of the target: an edge whose direction differs
    from its side is not turned round on the drop side, and is on the build side.
    A row with another word raises an error.
    """
    known = F.when(F.coalesce(F.col(applies), F.lit("forwards")).isin("forwards", "backwards"), F.col(applies)).otherwise(F.raise_error(F.concat(F.lit("no side: "), F.col(applies))).cast("string"))
    sides = F.when(known.isNull(), F.array(F.lit("forwards"), F.lit("backwards"))).otherwise(F.array(known))
    each = edges.select("node", "target", F.col(direction).alias("to"), F.explode(sides).alias("side"))
    turned = F.coalesce("to", "side") == "backwards"
    return each.select(F.when(turned, F.col("target")).otherwise(F.col("node")).alias("node"), F.when(turned, F.col("node")).otherwise(F.col("target")).alias("target"), "side")


def mirrored(actions: DataFrame) -> DataFrame:
    """(node, action, after): of one object, build comes after drop and diff after diffprep; one grouping of (node, action) rows."""
    pairs = F.array(F.struct(F.lit("build").alias("action"), F.lit("drop").alias("after")), F.struct(F.lit("diff").alias("action"), F.lit("diffprep").alias("after")))
    has = actions.groupBy("node").agg(F.collect_set("action").alias("has"))
    both = F.filter(pairs, lambda p: F.array_contains("has", p["action"]) & F.array_contains("has", p["after"]))
    return has.select("node", F.inline(both))


def usage_sets(objects: DataFrame, fqn: str = "fqn", owner: str = "owner", schema: str = "schema", comment: str | None = None) -> DataFrame:
    """(depset_id, node, applies, priority, to_fqn, fallback, condition): what the owner of an object must be allowed to do in its schema.

    To build an object its owner needs ``create`` on the schema (applies
    forwards), to drop it ``usage`` (backwards): granted to the owner, else to
    public, else as superuser, for which a fallback stands in. With ``comment``,
    a column, objects that have one need ``usage`` forwards, too, on the
    condition ``<fqn>.comment``. Objects without owner or schema need nothing.
    One pass over the objects, no shuffle.
    """
    needs = [("forwards", "create", None), ("backwards", "usage", None), *([("forwards", "usage", comment)] if comment else [])]
    rights = lambda right: (F.concat(F.lit("grant."), F.col(schema), F.lit(f".{right}:"), F.col(owner)), F.concat(F.lit("grant."), F.col(schema), F.lit(f".{right}:public")), F.concat(F.lit("privilege.role."), F.col(owner), F.lit(".superuser")))
    sets = []
    for applies, right, when in needs:
        condition = F.lit(None).cast("string") if when is None else F.concat(F.col(fqn).cast("string"), F.lit(".comment"))
        one = [F.struct(F.lit(applies).alias("applies"), F.concat_ws("/", F.col(fqn).cast("string"), F.lit(applies), F.lit(right)).alias("depset_id"), F.lit(i).alias("priority"), name.alias("to_fqn"), condition.alias("condition")) for i, name in enumerate(rights(right))]
        sets += one if when is None else [F.when(F.col(when).isNotNull(), x) for x in one]
    known = objects.filter(F.col(owner).isNotNull() & F.col(schema).isNotNull())
    return known.select(F.col(fqn).alias("node"), F.concat(F.lit("privilege.role."), F.col(owner), F.lit(".superuser")).alias("fallback"), F.inline(F.array_compact(F.array(*sets))))


def of_extensions(objects: DataFrame, extension: str = "extension", fqn: str = "fqn") -> DataFrame:
    """(node, target): an edge from each object that belongs to an extension to it; the extension's own objects are made and dropped with it."""
    return implied(objects, {extension: "extension"}, fqn)
