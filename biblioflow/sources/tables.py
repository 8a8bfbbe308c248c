"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory; only the columns a query selects are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
