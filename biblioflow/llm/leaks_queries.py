"""Queries on test passages in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.leaks import leaked_passages
from biblioflow.sources.tables import read_table


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked passage with its length, edits and place in the item and the document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaked_passages(docs, read_table(spark, sf_dir, "eval_items").select("item_id", "text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that hold a passage of them."""
    return p6_passages(spark, sf_dir).select("item_id", "doc_id").distinct()


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents concerned, with the number of items leaked in each."""
    return p6_passages(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("item_id").alias("items"), F.max("words").alias("longest"))


QUERIES = {"p6_found": p6_found, "p6_passages": p6_passages, "p6_documents": p6_documents}
ORACLE_SQL: dict[str, str] = {}
