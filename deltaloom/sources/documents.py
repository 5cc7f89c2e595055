"""XML documents with a nested schema, their headers, and their elements as the rows of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

#: How a schema tells an attribute, and the text of an element that has attributes or children.
ATTRIBUTE, TEXT = "_", "_VALUE"


def parsed(rows: DataFrame, xml: str, schema: str, name: str = "document", strict: bool = False) -> DataFrame:
    """``rows`` with the XML text in ``xml`` as the struct ``name`` of a nested schema: each text is read once, whatever number of fields it has.

    Attributes are fields ``_x``, an element's text beside them ``_VALUE``,
    elements that occur repeatedly are arrays. A field that a document lacks is
    null. Null texts give null; a text that is no XML gives a struct of nulls, or
    an error if ``strict``.
    """
    return rows.withColumn(name, F.from_xml(F.col(xml), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE", "attributePrefix": ATTRIBUTE, "valueTag": TEXT}))


def read(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """The elements ``row_tag`` of all files under ``path``, one row each, with the column ``file``; large files are split between tasks."""
    found = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", ATTRIBUTE).option("valueTag", TEXT).schema(schema).load(path)
    return found.select("*", F.col("_metadata.file_path").alias("file"))


def with_header(rows: DataFrame, headers: DataFrame, name: str = "header") -> DataFrame:
    """``rows`` with the header of their file as a struct (null without one); both come from ``read``. Two headers in a file raise an error."""
    fields = [c for c in headers.columns if c != "file"]
    only = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("several headers in "), F.col("file"))).cast("int"))
    one = headers.groupBy("file").agg(only.alias("many"), F.first(F.struct(*fields)).alias(name)).filter("many is null").drop("many")
    return rows.join(one, "file", "left")


def _parts(kind: DataType) -> StructType | None:
    kind = kind.elementType if isinstance(kind, ArrayType) else kind
    return kind if isinstance(kind, StructType) else None


def _is_attribute(f: StructField) -> bool:
    return f.name.startswith(ATTRIBUTE) and f.name != TEXT


def nodes(rows: DataFrame, key: str, document: str, root: str) -> DataFrame:
    """(id, parent, type, attrs, place, text) of all elements of the struct ``document``, as ``operators.tree`` takes them.

    id is ``<key>/<root>`` and so on down, with the place among its siblings of
    one name from the second level on; the order of siblings is that of the
    schema's fields, then of their arrays. Elements without attributes and
    children are leaves with a text. Attributes and elements that are null are
    left out, and so is a row without a document. The schema says how deep
    elements go: one pass for each kind of element, no rounds.
    """
    node = lambda at, kind: F.struct(F.lit(kind).alias("type"), at.alias("it"))
    first = rows.filter(F.col(document).isNotNull()).select(F.concat_ws("/", F.col(key).cast("string"), F.lit(root)).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("place"), F.col(document).alias("it"))
    out, todo = None, [(root, first)]
    while todo:
        kind, level = todo.pop()
        parts = _parts(level.schema["it"].dataType)
        told = [f for f in parts if _is_attribute(f)] if parts else []
        attrs = F.map_filter(F.map_from_entries(F.array(*(F.struct(F.lit(f.name[len(ATTRIBUTE) :]), F.col("it")[f.name].cast("string")) for f in told))), lambda _, v: v.isNotNull()) if told else F.create_map().cast("map<string,string>")
        said: Column = F.col("it").cast("string") if not parts else F.col("it")[TEXT].cast("string") if TEXT in parts.names else F.lit(None).cast("string")
        one = level.select("id", "parent", F.lit(kind).alias("type"), attrs.alias("attrs"), "place", said.alias("text"))
        out = one if out is None else out.unionByName(one)
        for n, f in enumerate(parts or []):
            if _is_attribute(f) or f.name == TEXT:
                continue
            items = F.col("it")[f.name] if isinstance(f.dataType, ArrayType) else F.array(F.col("it")[f.name])
            below = level.select(F.col("id").alias("parent"), F.posexplode(items).alias("nth", "it")).filter("it is not null")
            todo.append((f.name, below.select(F.concat(F.col("parent"), F.lit(f"/{f.name}"), F.col("nth").cast("string")).alias("id"), "parent", (F.lit(n << 40) + F.col("nth")).alias("place"), "it")))
    return out
