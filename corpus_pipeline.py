"""A corpus pipeline: each stage reads what the one before it kept.

The stages drop documents of low quality, keep one of each group of near duplicates, drop documents that overlap the
benchmark, mix the sources to weights of 1, 2 and 3, and write the token ids of the mix. All but the last return the
columns of documents; the last returns what is read back from the token files, a row for each document of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import decontaminate, mixing, near_dup, quality, token_planes
from corpuslens.llm.shared import materialise, shared_path


#: Rows that go to a Python worker at once; Spark's own 10,000 rows of text take some hundred MB of an executor.
TEXT_ROWS = 2000


def _in_small_batches(spark: SparkSession) -> None:
    """Bounds what tasks hand to Python at once, in a session that hasn't a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores as good; a null text is judged as an empty one, a null or shared id changes nothing."""
    _in_small_batches(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first_of_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates; rows without words are kept, null and shared ids are rows like others."""
    _in_small_batches(spark)
    return near_dup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text overlaps no benchmark item; null and empty texts overlap nothing."""
    _in_small_batches(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that takes words of a document; rows without words are not taken, a null source is a source."""
    _in_small_batches(spark)
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests read back from the files, in order of id; null ids come first, a null text has the end id only."""
    _in_small_batches(spark)
    path = shared_path(spark, "pipeline-ids")
    token_planes.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_planes.digests(spark, path)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_first_of_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: A trained classifier, signatures, hashed seeds and a random draw have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return docs
