"""Ordered text files: scripts and listings with a header that is kept or filled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ranked

#: A line that belongs to the header or footer of a file.
REMARK = "--"


def filled(lines: list[str], values: dict[str, str], before: list[str] | None = None) -> list[str]:
    """A header or footer: ``$name$`` is replaced by its value, and a line ``=>`` by the lines of ``before``, the previous file's.

    ``=> text`` stands for ``before`` or, without it, for the text. An unknown name
    is an error, ``$$`` is a dollar sign. Lines that don't begin with ``--`` get it.
    """

    def value(found: re.Match) -> str:
        if not found[1]:
            return "$"
        if found[1] not in values:
            raise ValueError(f"unknown name {found[1]} in a header")
        return values[found[1]]

    out: list[str] = []
    for line in lines:
        if line.startswith("=>"):
            rest = line[2:].strip()
            out += before if before else [rest] if rest else []
        else:
            out.append(re.sub(r"\$(\w*)\$", value, line))
    return [x if x.startswith(REMARK) else f"{REMARK} {x}" for x in out]


def write(rows: DataFrame, path: str, order: list[Column], text: str = "text", header: list[str] = (), footer: list[str] = (), rows_per_file: int = 1_000_000) -> None:
    """The column ``text`` as lines of text files in ``order``: the files in the order of their names, each in itself.

    Ranges of the order are sorted and written side by side, none of them by one
    task for all; the header is the beginning of the first file, the footer the
    end of the last. A null text is left out; a text of several lines stays so.
    What was under ``path`` is replaced, so ask for ``header_of`` it before.
    """
    body = rows.filter(F.col(text).isNotNull())
    files = max(1, -(-body.count() // rows_per_file))
    ends = [(turn, i, line) for turn, lines in ((0, header), (2, footer)) for i, line in enumerate(lines)]
    around = rows.sparkSession.createDataFrame(ends, f"deltaloom_turn int, deltaloom_nth int, `{text}` string")
    whole = body.withColumns({"deltaloom_turn": F.lit(1), "deltaloom_nth": F.lit(0)}).unionByName(around, allowMissingColumns=True)
    by = [F.col("deltaloom_turn"), F.col("deltaloom_nth"), *order]
    whole.repartitionByRange(files, *by).sortWithinPartitions(*by).select(text).write.mode("overwrite").text(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of all files under ``path`` in the order of their names, lines from 1; found without one task for all."""
    read = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return ranked(read, [F.col("file"), F.col("block"), F.col("at")], "line").select((F.col("line") + 1).alias("line"), "text")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The leading remarks of what lies under ``path``, such as a header to keep; nothing where there is no file or no remark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    told = lines(spark, path)
    first = told.filter(~F.coalesce(F.col("text").startswith(REMARK), F.lit(False))).agg(F.min("line")).first()[0]
    head = told.filter(F.col("text").startswith(REMARK)) if first is None else told.filter(F.col("line") < first)
    return [r.text for r in head.orderBy("line").collect()]
