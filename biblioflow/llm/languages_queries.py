"""Queries on the languages of descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.languages import language_stretches, languages_present
from biblioflow.sources.tables import read_table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "book_metadata").select("record_id", "description", "language")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the descriptions whose label doesn't name exactly the one language they are in."""
    each = languages_present(_texts(spark, sf_dir), "record_id", "description", "language")
    found = each.groupBy("record_id").agg(F.collect_set("language").alias("found"), F.min("labelled").alias("labelled"))  # seven at most
    return found.where((F.size("found") > 1) | ~F.col("labelled")).select("record_id", F.explode("found").alias("language"))


def p1_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of a description with its language and confidence."""
    return language_stretches(_texts(spark, sf_dir), "record_id", "description", "language").drop("label")


QUERIES = {"p1_found": p1_found, "p1_stretches": p1_stretches}
ORACLE_SQL: dict[str, str] = {}
