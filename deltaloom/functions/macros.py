"""Parsers and builders for privileges, options, signatures and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import split_quoted

# The letters of privilege lists.
PRIVILEGES = {"r": "select", "w": "update", "a": "insert", "d": "delete", "D": "truncate", "x": "references", "t": "trigger", "X": "execute", "U": "usage", "C": "create", "T": "temporary", "c": "connect"}


def grants(rows: DataFrame, acl: str, *keys: str, owner: str | None = None, own: str = "", public: str = "") -> DataFrame:
    """One row for each privilege of lists like ``{grantee=r*w/grantor,=U/grantor}``.

    (keys..., grantee, grantor, priv, privilege, with_grant). An empty grantee
    is ``public``; ``*`` after a letter is the grant option. A null list means
    that nothing was ever granted: with ``owner``, a column, it stands for the
    letters ``own`` granted to the owner and the letters ``public`` to all, both by
    the owner; without it, or with a null owner, it gives no rows. An empty list gives none.
    """
    if owner:
        usual = F.concat(F.lit("{"), F.col(owner), F.lit(f"={own}/"), F.col(owner), F.concat(F.lit(f",={public}/"), F.col(owner)) if public else F.lit(""), F.lit("}"))
        rows = rows.withColumn(acl, F.coalesce(acl, usual))
    item = F.explode(F.split(F.regexp_replace(acl, r"^\{(.*)\}$", "$1"), ",")).alias("item")
    items = rows.filter(F.col(acl).isNotNull()).select(*keys, item).filter("item <> ''")
    part = F.split("item", "[=/]")
    letters = F.explode(F.regexp_extract_all(F.get(part, F.lit(1)), F.lit(r"([a-zA-Z]\*?)"), F.lit(1))).alias("letter")
    grantee = F.when(F.get(part, F.lit(0)) == "", "public").otherwise(F.get(part, F.lit(0)))
    named = F.create_map(*(F.lit(x) for pair in PRIVILEGES.items() for x in pair))
    told = items.select(*keys, grantee.alias("grantee"), F.get(part, F.lit(2)).alias("grantor"), letters)
    return told.select(*keys, "grantee", "grantor", F.substring("letter", 1, 1).alias("priv"), F.try_element_at(named, F.substring("letter", 1, 1)).alias("privilege"), (F.length("letter") == 2).alias("with_grant"))


def automatic_grants(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected grants with automatic = 'no' if also found, else 'revoke'; found ones not expected are left to the caller."""
    mark = found.select(*keys).distinct().withColumn("deltaloom_found", F.lit(True))
    return expected.join(mark, keys, "left").withColumn("automatic", F.when(F.col("deltaloom_found"), "no").otherwise("revoke")).drop("deltaloom_found")


def options(text: Column) -> Column:
    """``{a=b,"c=d,e"}`` as an array of (name, value): commas within quotes do not split, the first ``=`` does. Empty pieces, as of a comma at the end, are left out."""
    inner = F.regexp_replace(text, r"^\{(.*)\}$", "$1")
    bare = F.filter(F.transform(split_quoted(inner), lambda p: F.regexp_replace(p, '"', "")), lambda p: p != "")
    return F.transform(bare, lambda p: F.struct(F.regexp_extract(p, r"(?s)^([^=]*)", 1).alias("name"), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1).alias("value")))


def key_values(text: Column) -> Column:
    """``a=b,c="d,e"`` as a map: commas within double quotes do not split, and the quotes go. A key told twice is an error."""
    return F.map_from_entries(options(text))


def with_defaults(names: Column, kinds: Column, defaults: Column) -> Column:
    """Parameters (position from 1, name, kind, value): the i-th default is that of the i-th of the last parameters."""
    gap = F.size(names) - F.size(defaults)
    return F.transform(names, lambda n, i: F.struct((i + 1).alias("position"), n.alias("name"), F.get(kinds, i).alias("kind"), F.when(i >= gap, F.get(defaults, F.greatest(i - gap, F.lit(0)))).alias("value")))


def signature(name: Column, arguments: Column) -> Column:
    """``name(a,b)``."""
    return F.concat(name, F.lit("("), F.array_join(arguments, ","), F.lit(")"))


def overloads(rows: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """(keys…, several, texts): what is called alike, as of one schema and name: whether it is more than one, and its texts in ``order``."""
    fields = [*order, *([] if text in order else [text])]
    found = F.sort_array(F.collect_list(F.struct(*fields)))
    return rows.groupBy(*keys).agg((F.count("*") > 1).alias("several"), F.transform(found, lambda x: x[text]).alias("texts"))


def unpivot_flags(rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """One row (keys..., flag) for each flag column that is true."""
    entries = F.array(*(F.when(F.col(f), F.lit(f)) for f in flags))
    return rows.select(*keys, F.explode(F.array_compact(entries)).alias("flag"))
