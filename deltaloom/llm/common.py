"""What the training-data operators share: intermediate tables, word rules, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than ASCII white space (space and \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver see: spark.checkpoint.dir.

    Only where the session names none and all runs on one machine (master
    ``local``, as in tests), a temporary folder is made and remembered in the
    session; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("deltaloom.shared.folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("deltaloom.shared.folder", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    It cuts the lineage: a lost executor costs at most the stage at hand, and
    what follows sees one fixed set of rows however often it is read.
    """
    path = f"{shared_folder(df.sparkSession)}/deltaloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes the files of a ``stored`` table that nothing needs any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freed() -> None:
    """Gives memory that is no longer needed back to the system: a Python worker lives on after its task and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``function`` for mapInArrow, whose memory is given back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            freed()

    return run


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of at most ``most`` bytes, or entries of lists, in ``column``; a longer value has one of its own."""
    import numpy as np

    length = pc.list_value_length if pa.types.is_list(batch.schema.field(column).type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def spread(df: DataFrame, groups: int, key: str = "group", together: int = 8) -> DataFrame:
    """``df`` dealt by ``key`` to more partitions than the session sets, where ``together`` groups in each need them, so that a task does not grow with the input."""
    parts = -(-groups // together)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, component), component the smallest id.

    Labels travel along the edges and then jump to the label of the label, so
    that long chains take a number of rounds near the logarithm of their
    length. Each round is a few shuffles of narrow rows and is written to the
    shared folder; nothing is gathered on the driver but one count.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        fresh = stored(moved.join(jump, "to").select("id", "was", F.least("to", "further").alias("component")), "labels")
        changed = fresh.filter("was <> component").limit(1).count()
        dropped(labels)
        labels = fresh
        if not changed:
            dropped(both)
            return labels.select("id", "component")
