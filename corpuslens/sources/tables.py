"""Corpus views over tables: passages are (pid, grp, ord, text), ordered within their group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.ordered import numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations are groups, turns their passages."""
    t = table(spark, folder, "conversations")
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("pid"), F.col("conv_id").alias("grp"), F.col("turn").alias("ord"), "text", "role")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document is a passage; its place in its source is its id, which need not be dense."""
    t = table(spark, folder, "documents")
    return t.select(F.col("doc_id").cast("string").alias("pid"), F.col("source").alias("grp"), F.col("doc_id").alias("ord"), "text")


def dense(passages: DataFrame) -> DataFrame:
    """Numbers the passages of each group from 0, in ranges of its order: a hot group is many tasks."""
    return numbered(passages.withColumnRenamed("ord", "__given"), [F.col("__given")], "ord", within="grp").drop("__given").select(*passages.columns)
