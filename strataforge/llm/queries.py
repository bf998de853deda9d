"""Queries p6 to p8 and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import leaks, residue, tokens


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(_documents(spark, sf), tokens.Merges())


def p6_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Characters and tokens of every document."""
    return p6_ids(spark, sf).select("doc_id", F.size("ids").alias("n_tokens"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(_documents(spark, sf), spark.read.parquet(f"{sf}/eval_items.parquet"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_longest(spark: SparkSession, sf: str) -> DataFrame:
    """The longest verbatim run of every leak and where it stands."""
    return _leaks(spark, sf)


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Documents free of evaluation passages."""
    return leaks.without_leaks(_documents(spark, sf), spark.read.parquet(f"{sf}/eval_items.parquet")).select("doc_id", "lang", "source")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(_documents(spark, sf)).select("doc_id").distinct()


def p8_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents of every source hold residue, by kind."""
    marked = residue.residue(_documents(spark, sf))
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("has_field").alias("n_fields"), F.count_if("is_notice").alias("n_notices"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_lengths, p7_found, p7_longest, p7_clean, p8_found, p8_kinds)}

SQL: dict[str, str] = {}
