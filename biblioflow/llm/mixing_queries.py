"""Queries on the mix of document sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from biblioflow.llm.mixing import mix, shares
from biblioflow.sources.tables import read_table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), read_table(spark, sf_dir, "source_targets"), "doc_id", "text", "source"


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed rows: every document as often as the mix uses it."""
    return mix(*_inputs(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return shares(*_inputs(spark, sf_dir))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE_SQL: dict[str, str] = {}
