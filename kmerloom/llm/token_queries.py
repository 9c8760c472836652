"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.tokens import decoded, encoded
from kmerloom.plans.registry import Registry
from kmerloom.session import table

REG = Registry()


@REG.query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")


@REG.query("p7_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(encoded(table(spark, sf_dir, "documents"), "doc_id", "text"), "key", "ids").select(F.col("key").alias("doc_id"), "text")
