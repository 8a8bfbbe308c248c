"""Queries on the surviving record of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm import survivors as s
from biblioflow.sources.tables import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file with several records and each field, the record whose value survives."""
    rows = read_table(spark, sf_dir, "book_metadata").select("source_hash", "record_id", "source", "fetched_at", "description", "publisher", "page_count", "subjects")
    short = s.short_names(rows, "publisher").select(F.col("publisher").alias("name"), F.lit(True).alias("short"))
    # Rows without a house's name are spread, so that they don't meet in one task; no text moves, only how good it is.
    name = F.coalesce(s.publisher_name(F.col("publisher")), F.concat(F.lit("\n"), F.pmod(F.hash("record_id"), F.lit(10_000))))
    judged = rows.select(
        "source_hash", "record_id", "source", "fetched_at", name.alias("name"), s.publisher_quality(F.col("publisher")).alias("publisher"), s.description_quality(F.col("description")).alias("description"),
        s.page_count_quality(F.col("page_count")).alias("page_count"), s.subjects_quality(F.col("subjects")).alias("subjects"),
    ).join(short, "name", "left")
    fields = [s.Field("publisher", F.when(F.col("short").isNull(), F.col("publisher"))), *(s.Field(f, F.col(f)) for f in ("description", "page_count", "subjects"))]
    return s.surviving_values(judged, "source_hash", "record_id", fields, "source", "fetched_at").select("source_hash", "field", "record_id")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each file: the value of each field and the record it comes from."""
    rows = read_table(spark, sf_dir, "book_metadata").select("source_hash", "record_id", "loaded_at", "description", "publisher", "page_count", "subjects")
    latest = F.max_by(F.struct("description", "publisher", "page_count", "subjects"), "loaded_at").alias("v")
    values = p4_found(spark, sf_dir).join(rows, ["source_hash", "record_id"]).groupBy("source_hash", "field", "record_id").agg(latest)
    out = []
    for f in ("description", "publisher", "page_count", "subjects"):
        own = F.col("field") == f
        out += [F.max(F.when(own, F.col("v")[f])).alias(f), F.max(F.when(own, F.col("record_id"))).alias(f"{f}_from")]
    return values.groupBy("source_hash").agg(*out)


QUERIES = {"p4_found": p4_found, "p4_records": p4_records}
ORACLE_SQL: dict[str, str] = {}
