"""Objects described as rows, from tables and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import with_entry

OBJECT = "fqn string, pqn string, type string, schema string, name string, relation string, parent string, depth int, attrs map<string,string>"


def describe(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "public", measured: bool = False) -> DataFrame:
    """One row for each schema, table and column; its size is the number of columns.

    A column's attributes are type, nullable and position, and comment if its
    metadata has one. By default only schemas are read. measured: the rows of
    all tables say whether a column is nullable (one scan and one row a table),
    so that a column without nulls is described as ``not null``.
    """
    rows = [(f"schema.{schema}", None, "schema", schema, schema, None, None, 0, {})]
    for name, table in tables.items():
        rows.append((f"table.{schema}.{name}", None, "table", schema, name, name, f"schema.{schema}", 1, {}))
        for place, f in enumerate(table.schema.fields, 1):
            attrs = {"type": f.dataType.simpleString(), "nullable": str(f.nullable).lower(), "position": str(place)}
            if "comment" in f.metadata:
                attrs["comment"] = f.metadata["comment"]
            rows.append((f"column.{schema}.{name}.{f.name}", f"column.{name}.{f.name}", "column", schema, f.name, name, f"table.{schema}.{name}", 2, attrs))
    out = spark.createDataFrame(rows, OBJECT)
    if not measured:
        return out
    found = None
    for name, table in tables.items():
        has = F.array(*(F.struct(F.lit(f"column.{schema}.{name}.{f.name}").alias("fqn"), F.coalesce(F.bool_or(F.col(f"`{f.name}`").isNull()), F.lit(True)).alias("has")) for f in table.schema.fields))
        one = table.agg(has.alias("told")).select(F.inline("told"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return out
    return out.join(found, "fqn", "left").withColumn("attrs", F.when(F.col("has").isNull(), F.col("attrs")).otherwise(with_entry(F.col("attrs"), F.lit("nullable"), F.col("has").cast("string")))).select(*out.columns)


def query(spark: SparkSession, text: str, **params) -> DataFrame:
    """SQL with named parameters, bound as values, never as text."""
    return spark.sql(text, args=params)


def best_version(files: DataFrame, wanted: list[int], name: str = "name", version: str = "version", path: str = "path") -> DataFrame:
    """For each name the path of the highest version (array of numbers) up to the wanted one."""
    limit = F.array(*(F.lit(v).cast("bigint") for v in wanted))
    return files.filter(F.col(version) <= limit).groupBy(name).agg(F.max_by(path, version).alias(path), F.max(version).alias(version))


def xml_attributes(rows: DataFrame, xml: str, paths: dict[str, str]) -> DataFrame:
    """Rows with a column for each XPath; null where nothing matches or the text is no XML is an error of the reader."""
    return rows.select("*", *(F.xpath_string(F.col(xml), F.lit(p)).alias(n) for n, p in paths.items()))
