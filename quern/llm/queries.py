"""Queries of the problems of this subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.leakage import find_leaks
from quern.llm.mixing import mix_documents, mix_shares, source_name
from quern.llm.reading_level import demanding_documents, fit_reading_level, reading_levels
from quern.llm.statements import ORACLE
from quern.llm.survivors import evaluation_survivors, merged_evaluations

__all__ = ["ORACLE", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _evaluation_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _read(spark, d, "evaluations"), _read(spark, d, "source_groups"), _read(spark, d, "source_files")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return evaluation_survivors(*_evaluation_tables(spark, d))


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    return merged_evaluations(*_evaluation_tables(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p6_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents and leaked items per task."""
    items = _read(spark, d, "eval_items")
    leaks = find_leaks(_read(spark, d, "documents"), items)
    return leaks.join(items.select("item_id", "task"), "item_id").groupBy("task").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("item_id").alias("items"))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with at most one word changed in ten."""
    return find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"), max_edits=1)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return demanding_documents(_read(spark, d, "documents"), _read(spark, d, "level_labels"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Language, expected level and level distribution of every document."""
    documents = _read(spark, d, "documents")
    return reading_levels(documents, fit_reading_level(documents, _read(spark, d, "level_labels")))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """English documents per source and nearest level."""
    documents = _read(spark, d, "documents")
    levels = reading_levels(documents, fit_reading_level(documents, _read(spark, d, "level_labels")), keep=["source"]).where("language = 'en'")
    return levels.groupBy(source_name(F.col("source")).alias("source"), F.round("level").cast("int").alias("nearest_level")).agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_merged, p6_found, p6_tasks, p6_near, p7_mix, p7_shares, p8_found, p8_levels, p8_profile)}
