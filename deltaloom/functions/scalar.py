"""The scalar language: null is both missing and false, every other value is true."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*values: Column) -> Column:
    """The last value if none is null, else null."""
    present = reduce(lambda a, b: a & b, (v.isNotNull() for v in values))
    return F.when(present, values[-1])


def first_of(*values: Column) -> Column:
    """The first value that is not null."""
    return F.coalesce(*values)


def negated(value: Column) -> Column:
    """True for null, null for all else."""
    return F.when(value.isNull(), F.lit(True))


def same(a: Column, b: Column) -> Column:
    """Equality that is false, never null; null equals nothing, not even null."""
    return F.coalesce(a == b, F.lit(False))


def folded_sum(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, values)


def folded_difference(first: Column, *rest: Column) -> Column:
    """Unary minus for one value, else a left fold."""
    return reduce(lambda a, b: a - b, rest, first) if rest else -first


def joined_text(*values: Column) -> Column:
    """Concatenation that skips nulls; empty if all are null."""
    return F.concat_ws("", *(v.cast("string") for v in values))


def join_list(items: Column, separator: str = "") -> Column:
    """Items with a separator; empty for a null list."""
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def split_list(text: Column, delimiters: str) -> Column:
    """Pieces between any of the delimiter characters: empty pieces between neighbours stay, one empty piece at the end goes."""
    pieces = F.split(text, "[" + "".join("\\" + d for d in delimiters) + "]")
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def split_quoted(text: Column, delimiter: str = ",") -> Column:
    """Pieces at delimiters outside double quotes; the quotes stay, and so do empty pieces. An empty text has no pieces."""
    piece = rf'{delimiter}((?:"[^"]*"|[^"{delimiter}])*)'
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(delimiter), text), F.lit(piece), F.lit(1)))


def replaced(text: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; groups as $1 to $9."""
    return F.regexp_replace(text, pattern, replacement)


def replaced_first(text: Column, pattern: str, replacement: str) -> Column:
    """The first match replaced. ``replacement`` is plain text."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def matches(pattern: str, text: Column) -> Column:
    """True if the pattern is found; null for a null subject."""
    return text.rlike(pattern)


def head(items: Column) -> Column:
    return F.get(items, F.lit(0))


def tail(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def list_length(items: Column) -> Column:
    """Null for a null list."""
    return F.when(items.isNotNull(), F.size(items))


def selected(container: Column, *keys) -> Column:
    """Chained lookup: an int is a place from 0, a string a map key; null wherever one is missing."""
    for key in keys:
        container = F.get(container, F.lit(key)) if isinstance(key, int) else F.try_element_at(container, F.lit(key))
    return container


def first_match(items: Column, pattern: str) -> Column:
    """The first element in which the pattern is found."""
    return F.get(F.filter(items, lambda x: x.rlike(pattern)), F.lit(0))


def with_entry(entries: Column, key: Column, value: Column) -> Column:
    """A map with one entry set, replaced if it was there."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(key, value))


def to_int(text: Column) -> Column:
    """The integer if the text is one (spaces around and a sign allowed), else null."""
    return F.when(text.rlike(r"^ *[+-]?[0-9]+ *$"), F.trim(text).try_cast("bigint"))


def int_or_text(text: Column) -> Column:
    """The integer's plain form (``7`` for `` +07``) if the text is one, else the text unchanged; null for null."""
    return F.coalesce(to_int(text).cast("string"), text)


def order_key(value: Column) -> Column:
    """(kind, n, s): a key for sorts, ``max_by`` and comparisons of values of mixed kinds: null, then numbers, then texts.

    A text that is an integer counts as a number. Numbers are in the order of
    numbers and texts in that of their bytes. A comparison of each pair by its own
    kinds (numbers and texts as texts) would not be an order: 20 < 100 < '1a' < 20.
    """
    text = value.cast("string")
    n = to_int(text)
    return F.struct(F.when(text.isNull(), 0).when(n.isNotNull(), 1).otherwise(2).alias("kind"), n.alias("n"), F.when(n.isNull(), text).alias("s"))


def list_key(items: Column) -> Column:
    """(kind, items): a key for lists of such values, in the order of their first different items, a list before its extensions; null before all lists."""
    return F.struct(F.when(items.isNull(), 0).otherwise(3).alias("kind"), F.transform(items, order_key).alias("items"))


def version(text: Column) -> Column:
    """Parts between dots as (n, s): a number, or the text where it is none. ``version_key`` puts them in order."""
    return F.transform(F.split(text, r"\."), lambda p: F.struct(to_int(p).alias("n"), F.when(to_int(p).isNull(), p).alias("s")))


def version_key(text: Column) -> Column:
    """The parts between dots as ``order_key``; versions compare as arrays, so 1.9 < 1.10 < 1.a."""
    return F.transform(F.split(text, r"\."), order_key)


def version_numbers(text: Column) -> Column:
    """Numeric parts only; compares in the order of versions."""
    return F.transform(F.split(text, r"\."), to_int)


def compact_timestamp(at: Column) -> Column:
    """yyyyMMddHHmmss."""
    return F.date_format(at, "yyyyMMddHHmmss")


def cons(first: Column, items: Column) -> Column:
    """``first`` before the items; a null list counts as empty."""
    return F.coalesce(F.array_prepend(items, first), F.array(first))


def inserted(items: Column, others: Column) -> Column:
    """Union of two lists as sets, in the order of first appearance; a null list counts as empty."""
    return F.coalesce(F.array_union(items, others), F.array_distinct(items), F.array_distinct(others))


def removed(items: Column, item: Column) -> Column:
    """The list without any element equal to ``item``; a null item removes nothing."""
    return F.filter(items, lambda x: ~F.coalesce(x == item, F.lit(False)))


def ordered_by(items: Column, smaller) -> Column:
    """The list in the order of a comparison: ``smaller(x, y)`` says whether x comes before y."""
    return F.array_sort(items, lambda x, y: F.when(smaller(x, y), -1).when(smaller(y, x), 1).otherwise(0))


def user() -> Column:
    """Name of the session's user."""
    return F.current_user()


def looked_up(key: Column, known: dict[str, str]) -> Column:
    """The value of a fixed table, null if the key is not in it (such as a stream format's version by database type)."""
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[key] if known else F.lit(None).cast("string")


def member(name: Column, value: Column) -> Column:
    """A map of one entry whose name is computed; empty for a null name."""
    return F.when(name.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(name, value))
