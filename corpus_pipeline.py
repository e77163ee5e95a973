"""The training-corpus pipeline: five operators one after the other over ``documents``.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``; its rows are written as Parquet in the shared folder and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatlake.llm import decontaminate, linededup, packing, quality, simhash
from chatlake.llm.common import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.accepted(docs, quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: a line that several documents hold stays in the first of them alone."""
    return linededup.without_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each class stays."""
    return simhash.without_near_copies(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of training sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", fresh_lines),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", no_test_items),
    ("packing", packed),
]

#: Hashed text, XXH64 and byte-pair merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
