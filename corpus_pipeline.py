"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import minhash, pack, pareto_mix, suffix_dedup, zlang
from deltaloom.llm.common import stored
from deltaloom.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression by language does not reject; the dictionaries come from the documents that say their language."""
    return zlang.identify(docs, zlang.fit(docs)).filter("not rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    return minhash.one_of_each(docs)


def without_cut_characters(raw: Column) -> Column:
    """UTF-8 text of bytes, without the parts of characters that a cut has left; U+FFFD that the text itself holds stays."""
    mark, own, lost = "\ue000", "\ue001", "\ue002"
    told = F.replace(F.replace(raw.cast("string"), F.lit(mark), F.lit(mark + own)), F.lit("\ufffd"), F.lit(mark + lost))
    left = F.replace(F.make_valid_utf8(told), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(left, F.lit(mark + lost), F.lit("\ufffd")), F.lit(mark + own), F.lit(mark))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; characters cut in part go too, and n_chars follows.

    A null text stays null. Every document stays, those of which nothing is left with an empty text.
    """
    cut = suffix_dedup.remove_repeats(docs.withColumn("deltaloom_null", F.col("text").isNull()))
    text = F.when(F.size("spans") > 0, without_cut_characters(F.col("kept"))).otherwise(F.col("kept").cast("string"))
    out = cut.withColumn("text", F.when(~F.col("deltaloom_null"), text))
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as the mix has it."""
    copies = pareto_mix.mix(docs).filter("copies > 0")
    return copies.withColumn("deltaloom_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of at most 2048."""
    return pack.pack(docs, tokenizer_file())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("mix", mix), ("packing", packing)]

#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
