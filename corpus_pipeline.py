"""A training-data pipeline over ``documents``: language filter, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. The first three return the
columns of ``documents``; the last one returns a row of token counts and digests for each document kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, langid, queries, simhash
from quern.session import bounded
from quern.sources.staging import new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language the filters know: no letter, or under a fifth of the n-grams known.

    Null and empty texts have no letter and go. Rows are decided one by one, so repeated ones stay or go alike; without a
    labelled row no language is known and all go. Texts are read whole; other columns are kept."""
    bounded(spark)
    return langid.keep_known(docs, queries.language_filters(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group alike in 0.8 of its five-word shingles.

    Rows are decided one by one: of equal rows one stays. Texts without a word, null ones too, are one group; null ids come
    after all others. Other columns are kept."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of documents, and drops documents that are half benchmark or more."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left. A null text is an empty one, with no tokens; repeated rows each
    give a row, an empty table none."""
    return bpe.digests(docs, queries.vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: No stage can be said in SQL: the first learns filters, the second links fingerprints, the last encodes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
