"""Keyed comparison of two snapshots by declarative rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """A compared column. rebuild: a difference means the object must be made anew. fail: a difference is an error."""

    name: str
    rebuild: bool = False
    fail: str | None = None


@dataclass(frozen=True)
class Rule:
    """How objects of one type are compared: their key columns, compared attributes, text columns (null is empty), and by array column the rule of its elements. rebuild: any difference means that the object must be made anew."""

    key: tuple[str, ...]
    attributes: tuple[Attribute, ...] = ()
    texts: tuple[str, ...] = ()
    elements: dict[str, "Rule"] = field(default_factory=dict)
    rebuild: bool = False


def _changed(name: str, text: bool = False) -> Column:
    old, new = F.col(f"old.{name}"), F.col(f"new.{name}")
    if text:
        old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return ~old.eqNullSafe(new)


def paired(old: DataFrame, new: DataFrame, rule: Rule) -> DataFrame:
    """Full outer join by key: the key columns, and the structs ``old`` and ``new``."""
    key = list(rule.key)
    a = old.select(*key, F.struct(*old.columns).alias("old"))
    b = new.select(*key, F.struct(*new.columns).alias("new"))
    return a.join(b, key, "full_outer")


def statuses(old: DataFrame, new: DataFrame, rule: Rule) -> DataFrame:
    """(key..., status): new, gone, rebuild, diff or none. A difference in a ``fail`` attribute raises its message."""
    both = paired(old, new, rule)
    some = lambda cols: reduce(lambda a, b: a | b, cols, F.lit(False))
    rebuilt = some([_changed(a.name) for a in rule.attributes if a.rebuild])
    changed = some([*(_changed(a.name) for a in rule.attributes), *(_changed(t, True) for t in rule.texts)])
    rebuilt = changed if rule.rebuild else rebuilt
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(rebuilt, "rebuild").when(changed, "diff").otherwise("none")
    for a in rule.attributes:
        if a.fail:
            wrong = F.col("old").isNotNull() & F.col("new").isNotNull() & _changed(a.name)
            told = F.concat_ws(" ", F.lit(a.fail), F.coalesce(F.col(f"old.{a.name}").cast("string"), F.lit("<null>")), F.coalesce(F.col(f"new.{a.name}").cast("string"), F.lit("<null>")))
            status = F.when(wrong, F.raise_error(told).cast("string")).otherwise(status)
    return both.select(*rule.key, status.alias("status"))


def attribute_changes(old: DataFrame, new: DataFrame, rule: Rule) -> DataFrame:
    """(key..., attr, status, old, new) for each attribute that differs in objects of both snapshots.

    diff: both have a value; gone or new: only the old or the new one has.
    """
    both = paired(old, new, rule).filter(F.col("old").isNotNull() & F.col("new").isNotNull())
    entry = lambda a: F.struct(F.lit(a.name).alias("attr"), F.col(f"old.{a.name}").cast("string").alias("old"), F.col(f"new.{a.name}").cast("string").alias("new"))
    long = both.select(*rule.key, F.inline(F.array(*(entry(a) for a in rule.attributes)))).filter("not (old <=> new)")
    return long.select(*rule.key, "attr", F.when(F.col("new").isNull(), "gone").when(F.col("old").isNull(), "new").otherwise("diff").alias("status"), "old", "new")


def with_child_status(parents: DataFrame, children: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """Parents' statuses after their children's: none becomes diffkids if a child changed.

    A child that is gone does not count unless ``strict``.
    """
    counts = F.col("status").isin("new", "diff", "rebuild", "diffkids", *(["gone"] if strict else []))
    marked = children.groupBy(*on).agg(F.bool_or(counts).alias("deltaloom_child"))
    status = F.when((F.col("status") == "none") & F.coalesce("deltaloom_child", F.lit(False)), "diffkids").otherwise(F.col("status"))
    return parents.join(marked, on, "left").withColumn("status", status).drop("deltaloom_child")


def swapped(statuses: DataFrame) -> DataFrame:
    """The comparison the other way round: new and gone change places."""
    return statuses.withColumn("status", F.when(F.col("status") == "new", "gone").when(F.col("status") == "gone", "new").otherwise(F.col("status")))


def applied(old: DataFrame, new: DataFrame, rule: Rule) -> DataFrame:
    """What ``old`` becomes when the differences are carried out: gone rows go, new and rebuilt ones come from ``new``, and of the others only the attributes and texts that differ are set."""
    key, changed = list(rule.key), [a.name for a in rule.attributes] + list(rule.texts)
    status = statuses(old, new, rule)
    whole = new.join(status.filter("status in ('new', 'rebuild')"), key, "left_semi")
    kept = old.join(status.filter("status in ('none', 'diff')"), key, "left_semi")
    values = new.select(*key, F.struct(F.lit(True).alias("deltaloom_there"), *changed).alias("deltaloom_new"))
    edited = kept.join(values, key).withColumns({c: F.col(f"deltaloom_new.{c}") for c in changed})
    return edited.select(*old.columns).unionByName(whole.select(*old.columns))


def _exploded(old: DataFrame, new: DataFrame, rule: Rule, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The elements in ``name``: the old ones that may match, the new ones, and the old ones that repeat an earlier key."""
    key = list(nested_rule(rule, name).key)
    new = new.select(*rule.key, F.inline(name))
    many = F.count("*").over(Window.partitionBy(*key)) > 1
    told = F.concat_ws(" ", F.lit(f"repeated element in {name}:"), *(F.col(k).cast("string") for k in key))
    last = key[-1]
    once = new.withColumn(last, F.when(many, F.raise_error(told).cast(new.schema[last].dataType)).otherwise(F.col(last)))
    placed = old.select(*rule.key, F.posexplode(name).alias("deltaloom_place", "deltaloom_element")).select(*rule.key, "deltaloom_place", "deltaloom_element.*")
    placed = placed.withColumn("deltaloom_nth", F.row_number().over(Window.partitionBy(*key).orderBy("deltaloom_place")))
    of = lambda which: placed.filter(which).drop("deltaloom_place", "deltaloom_nth")
    return of("deltaloom_nth = 1"), once, of("deltaloom_nth > 1")


def element_statuses(old: DataFrame, new: DataFrame, rule: Rule, name: str) -> DataFrame:
    """(key..., element's key..., status): the structs in the array column ``name``, matched by their own key within objects of one key.

    An element that is twice in a new object raises an error. Of equal ones in
    an old object the first in the array meets the new one, the others are gone.
    Elements of elements: ``deep_statuses``.
    """
    inner = nested_rule(rule, name)
    first, once, rest = _exploded(old, new, rule, name)
    return statuses(first, once, inner).unionByName(rest.select(*inner.key, F.lit("gone").alias("status")))


def deep_statuses(old: DataFrame, new: DataFrame, rule: Rule) -> DataFrame:
    """(key..., path, element, status): objects, their elements, the elements' elements and so on, as deep as the rule goes.

    path: names of the array columns on the way, joined by dots; empty for the
    objects. element: the keys on the way as texts. What is on both sides and
    none by itself is diff if anything in it is not none, up to the object.
    Elements of what is new or gone are new or gone; repeated elements as in
    ``element_statuses``. Key columns on one way have different names. One pass
    of joins for each array column of the rule.
    """
    top = list(rule.key)

    def walked(was: DataFrame, now: DataFrame, own: Rule, path: tuple[str, ...]) -> DataFrame:
        here, below = statuses(was, now, own), None
        by_element = "rebuild" if own.rebuild else "diff"
        for name in own.elements:
            inner = nested_rule(own, name)
            first, once, rest = _exploded(was, now, own, name)
            found = walked(first, once, inner, (*path, name)).unionByName(walked(rest, once.limit(0), replace(inner, attributes=(), texts=()), (*path, name)), allowMissingColumns=True)
            marked = found.filter("status <> 'none'").select(*own.key).distinct().withColumn("deltaloom_element", F.lit(True))
            status = F.when((F.col("status") == "none") & F.col("deltaloom_element"), by_element).otherwise(F.col("status"))
            here = here.join(marked, list(own.key), "left").withColumn("status", status).drop("deltaloom_element")
            below = found if below is None else below.unionByName(found, allowMissingColumns=True)
        keys = F.array(*(F.col(k).cast("string") for k in own.key[len(top) :])).cast("array<string>")
        here = here.select(*own.key, F.lit(".".join(path)).alias("path"), keys.alias("element"), "status")
        return here if below is None else here.unionByName(below, allowMissingColumns=True)

    return walked(old, new, rule, ()).select(*top, "path", "element", "status")


def nested_rule(rule: Rule, name: str) -> Rule:
    """The rule of the elements in ``name``, its key led by the object's."""
    return replace(rule.elements[name], key=(*rule.key, *rule.elements[name].key))


def tree_statuses(old: DataFrame, new: DataFrame, rule: Rule) -> DataFrame:
    """``statuses`` in which an object on both sides is diff, too, if any of its elements is not none."""
    out = statuses(old, new, rule)
    for name in rule.elements:
        marked = element_statuses(old, new, rule, name).filter("status <> 'none'").select(*rule.key).distinct().withColumn("deltaloom_element", F.lit(True))
        status = F.when((F.col("status") == "none") & F.col("deltaloom_element"), "rebuild" if rule.rebuild else "diff").otherwise(F.col("status"))
        out = out.join(marked, list(rule.key), "left").withColumn("status", status).drop("deltaloom_element")
    return out


def rules_of(pairs: list[tuple[str, Rule]]) -> dict[str, Rule]:
    """Rules by type; a type told twice and a rule without a key are errors."""
    out: dict[str, Rule] = {}
    for kind, rule in pairs:
        if kind in out:
            raise ValueError(f"two rules for {kind}")
        if not rule.key:
            raise ValueError(f"no key in the rule for {kind}")
        out[kind] = rule
    return out


def both_sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dependencies or contexts of a comparison: the old description's count backwards, the new one's forwards (column ``applies``)."""
    return old.withColumn("applies", F.lit("backwards")).unionByName(new.withColumn("applies", F.lit("forwards")))


def merged_header(old: DataFrame, new: DataFrame, both: tuple[str, ...] = ("dbname", "time")) -> DataFrame:
    """The header of a comparison: the new side's columns, and those in ``both`` of the old side with a 2 to their names. Headers are tables of one row; of an empty one the columns are null, more than one row is an error."""

    def one(d: DataFrame) -> DataFrame:
        many = F.when(F.count("*") > 1, F.raise_error(F.lit("several headers")).cast("int"))
        return d.agg(many.alias("deltaloom_many"), F.first(F.struct(*d.columns)).alias("h")).select(F.coalesce("deltaloom_many", F.lit(0)).alias("deltaloom_one"), "h.*")

    from_old = old.select(*(F.col(c).alias(f"{c}2") for c in both))
    return one(new).join(one(from_old), "deltaloom_one").drop("deltaloom_one")


def filled(template: str, old: str = "old", new: str = "new") -> Column:
    """``template`` with ``{old.x}`` and ``{new.x}`` replaced by fields of two struct columns; another name or a lone brace is an error."""
    sides = {"old": old, "new": new}
    parts = []
    for place, part in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if place % 2 == 0:
            if "{" in part or "}" in part:
                raise ValueError(f"a lone brace in {template}")
            parts.append(F.lit(part))
        else:
            side, dot, name = part.partition(".")
            if not dot or side not in sides:
                raise ValueError(f"unknown name {part} in {template}")
            parts.append(F.col(f"{sides[side]}.{name}").cast("string"))
    return F.concat(*parts)


def change_edges(old: DataFrame, new: DataFrame, rule: Rule, templates: dict[str, str]) -> DataFrame:
    """(key..., attr, target): for each attribute that differs, the dependency its template names; a template with a null field names none."""
    both = paired(old, new, rule).filter(F.col("old").isNotNull() & F.col("new").isNotNull())
    named = (F.when(_changed(attr), F.struct(F.lit(attr).alias("attr"), filled(text).alias("target"))) for attr, text in templates.items())
    return both.select(*rule.key, F.inline(F.array_compact(F.array(*named)))).filter("target is not null")


def precedence(own: Column, rebuild: Column, has_rule: Column, kids: Column) -> Column:
    """Status of an object that is on both sides: rebuild or diff by its own differences, else UNKNOWN without a rule, else diffkids, else none."""
    no = F.lit(False)
    return F.when(F.coalesce(rebuild, no), "rebuild").when(F.coalesce(own, no), "diff").when(~F.coalesce(has_rule, no), "UNKNOWN").when(F.coalesce(kids, no), "diffkids").otherwise("none")
