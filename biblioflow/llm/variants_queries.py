"""Queries on the spellings of authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm.variants import variant_groups, variant_pairs
from biblioflow.sources.tables import read_table


def author_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of all three author fields."""
    books = read_table(spark, sf_dir, "book_metadata").select(F.col("author").alias("name"))
    works = read_table(spark, sf_dir, "search_documents").select(F.explode("author_name").alias("name"))
    items = read_table(spark, sf_dir, "autocomplete_items").select(F.col("author.name").alias("name"))
    return books.unionByName(works).unionByName(items)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different author strings that mean the same one."""
    return variant_pairs(author_strings(spark, sf_dir), "name")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author string with its group and the number of spellings linked to it."""
    groups = variant_groups(author_strings(spark, sf_dir), "name")
    sizes = groups.groupBy("group_id").agg((F.count(F.lit(1)) - 1).alias("links"))
    return groups.join(sizes, "group_id").select("name", "group_id", "links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLE_SQL: dict[str, str] = {}
