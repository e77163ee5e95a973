"""The queries of this subpackage, ``name -> f(spark, sf_dir)``, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatlake.llm import binary, decontaminate, imatch, langid, linededup, packing, pii, quality, simhash, tokencount
from chatlake.sources.shared import spread

SQL: dict[str, str] = {"op1_line_dedup": linededup.ORACLE, "op3_decontaminate": decontaminate.ORACLE}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, dealt over all cores if its files have fewer row groups than that."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing operator over instruction data, where the limit on loss-bearing tokens binds."""
    return packing.packed_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints_with_edits(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.packed_rows(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(documents(spark, sf_dir), quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "packed_conversations": packed_conversations,
    "op5_imatch": op5_imatch,
    "op6_language": op6_language,
    "op7_token_binary": op7_token_binary,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "pipeline": pipeline,
}
