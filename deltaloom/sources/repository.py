"""A tree of objects as files: scatter by type, gather, and what has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType


def content_hash(columns: list[str]) -> Column:
    """md5 of the columns as JSON: null differs from empty, and no value runs into the next."""
    return F.md5(F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)))))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below ``path`` whose name fits ``pattern`` (as of a shell); contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")


def scatter_status(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """(key..., status): NEW, MODIFIED, UNCHANGED, or OLD for what is stored and no longer there. Both have key and hash."""
    a, b = stored.select(*key, F.col("hash").alias("was")), fresh.select(*key, F.col("hash").alias("is"))
    status = F.when(F.col("was").isNull(), "NEW").when(F.col("is").isNull(), "OLD").when(F.col("was") == F.col("is"), "UNCHANGED").otherwise("MODIFIED")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def scatter(objects: DataFrame, path: str, by: str = "type") -> None:
    """One folder for each value of ``by``."""
    objects.write.partitionBy(by).mode("overwrite").parquet(path)


def gather(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All folders as one table again. With a schema its types hold for the folders' names, too, so that ``001`` stays a text; without one Spark guesses them."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and len(files.listStatus(at)) > 0


def row_hash(rows: DataFrame, columns: list[str]) -> Column:
    """sha256 of the columns as JSON; nulls differ from empty values, the order of a map's entries does not count."""
    flat = [F.array_sort(F.map_entries(c)) if isinstance(rows.schema[c].dataType, MapType) else F.col(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*(x.alias(f"c{i}") for i, x in enumerate(flat))), {"ignoreNullFields": "false"}), 256)


def snapshot_hashes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by…, rows, hash): one hash for the rows of each group, whatever their order, repeated rows counted: sums of two 64-bit hashes of each row's sha256."""
    one = rows.select(*by, row_hash(rows, rows.columns).alias("deltaloom_hash"))
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), "deltaloom_hash").cast("decimal(38,0)")).cast("string")
    return one.groupBy(*by).agg(F.count("*").alias("rows"), F.concat_ws(":", total(1), total(2)).alias("hash"))


def sync(objects: DataFrame, path: str, by: str = "type", check_only: bool = False) -> DataFrame:
    """Writes only the folders whose rows differ from those under ``path``, removes those of which nothing is left, and tells (by, status).

    status: NEW, MODIFIED, UNCHANGED or OLD (removed). Rows are compared as
    multisets, by counts of equal rows; where columns have come, gone or changed
    their type, every folder that is there and stays is MODIFIED. An empty text
    in ``by`` counts as null, as a folder's name can't tell them apart. Only
    the folders' names and statuses, as many as values of ``by``, come to the
    driver. check_only: tells the same and writes nothing.
    """
    spark = objects.sparkSession
    columns = [*(c for c in objects.columns if c != by), by]
    fresh = objects.select(columns)
    if isinstance(fresh.schema[by].dataType, StringType):
        fresh = fresh.withColumn(by, F.nullif(by, F.lit("")))
    there, same_columns = fresh.limit(0), True
    if _there(spark, path):
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
        as_found = StructType([StructField(f.name, fresh.schema[by].dataType if f.name == by else f.dataType) for f in found])
        same_columns = {f.name: f.dataType for f in as_found} == {f.name: f.dataType for f in fresh.schema}
        known = {f.name for f in as_found}
        there = gather(spark, path, as_found).select(*((F.col(c).try_cast(fresh.schema[c].dataType) if c in known else F.lit(None).cast(fresh.schema[c].dataType)).alias(c) for c in columns))
    sides = fresh.select(by, row_hash(fresh, columns).alias("deltaloom_hash"), F.lit(1).alias("deltaloom_is"), F.lit(0).alias("deltaloom_was"))
    sides = sides.unionByName(there.select(by, row_hash(there, columns).alias("deltaloom_hash"), F.lit(0).alias("deltaloom_is"), F.lit(1).alias("deltaloom_was")))
    rows = sides.groupBy(by, "deltaloom_hash").agg(F.sum("deltaloom_is").alias("deltaloom_n"), F.sum("deltaloom_was").alias("deltaloom_m"))
    equal = F.bool_and(F.col("deltaloom_n") == F.col("deltaloom_m")) & F.lit(same_columns)
    status = F.when(F.sum("deltaloom_m") == 0, "NEW").when(F.sum("deltaloom_n") == 0, "OLD").when(equal, "UNCHANGED").otherwise("MODIFIED")
    told = rows.groupBy(by).agg(status.alias("status")).collect()
    if not check_only:
        changed = [r[by] for r in told if r.status in ("NEW", "MODIFIED")]
        if changed:
            some = fresh.filter(F.col(by).isin([c for c in changed if c is not None]) | (F.col(by).isNull() if None in changed else F.lit(False)))
            some.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for r in told:
            if r.status == "OLD":
                name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, None if r[by] is None else str(r[by]))
                at = spark._jvm.org.apache.hadoop.fs.Path(path, name)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.createDataFrame([(r[by], r.status) for r in told], fresh.select(by).schema.add("status", "string"))
