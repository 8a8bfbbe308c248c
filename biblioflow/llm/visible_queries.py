"""Queries on texts that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.visible import consistent_form, look_alike_classes, look_alike_pairs
from biblioflow.sources.tables import read_table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but aren't byte-identical."""
    return look_alike_pairs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like another, with their class."""
    return look_alike_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its consistent form."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return consistent_form(docs).select("doc_id", "consistent", (~F.col("text").eqNullSafe(F.col("consistent"))).alias("changed"))


QUERIES = {"p8_found": p8_found, "p8_classes": p8_classes, "p8_consistent": p8_consistent}
ORACLE_SQL: dict[str, str] = {}
