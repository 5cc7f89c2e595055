"""Quoting of SQL literals and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SQL words that cannot stand as an identifier without quotes.
RESERVED = ("all", "and", "any", "array", "as", "asc", "both", "case", "cast", "check", "column", "constraint", "create", "default", "desc", "distinct", "do", "else", "end", "except", "for", "foreign", "from", "grant", "group", "having", "in", "intersect", "into", "leading", "limit", "not", "null", "offset", "on", "only", "or", "order", "primary", "references", "select", "some", "table", "then", "to", "trailing", "true", "union", "unique", "user", "using", "when", "where", "with")


def quote_literal(text: Column) -> Column:
    """In single quotes, those within doubled; null for null."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_identifier(name: Column) -> Column:
    """As it is if it needs no quotes: lower-case letters, digits and underscores, no digit first, no reserved word."""
    plain = name.rlike("^[a-z_][a-z0-9_]*$") & ~name.isin(*RESERVED)
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"')))


def quote_qualified(schema: Column, name: Column) -> Column:
    """schema.name; a null or empty schema is dropped."""
    return F.when(F.coalesce(schema, F.lit("")) == "", quote_identifier(name)).otherwise(F.concat(quote_identifier(schema), F.lit("."), quote_identifier(name)))
