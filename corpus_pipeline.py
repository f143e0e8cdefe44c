"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, mixture.

Each stage takes what its predecessor kept and calls one operator of ``orderlens.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import decontaminate, language, mixing, pii, simhash
from orderlens.session import remove, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    found = language.predict(docs.select(*COLUMNS), language.learn(docs))
    return found.where(~F.col("rejected")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: 3-word shingles, at most 2 differing bits."""
    return simhash.deduplicated(docs.select(*COLUMNS), size=3, most=2)


def without_test_items(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{folder}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced."""
    clean = pii.sanitised(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def target_mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_each),
    ("decontaminate", without_test_items),
    ("pii", without_personal_data),
    ("mixing", target_mixture),
]

#: Learned models, alignments and iterations are not one SQL statement; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next.

    A result is deleted when the next one is written; that of the last but one stage stays, as the
    returned DataFrame reads it.
    """
    docs, read = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        if read is not None:
            remove(spark, read)  # nothing reads it any more
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, folder)
