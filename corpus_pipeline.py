"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing of ``documents``.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before it kept, and returns
the columns of documents, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact, language, mixing, near, packing
from lectern.session import checkpointed


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that are in none of the learned languages."""
    return language.identified(docs, language.fit(language.learning_rows(docs)))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_repeats(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
