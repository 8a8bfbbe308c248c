"""Queries on trailing periods of reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.operators.trailing import strip_blanks, trailing_totals
from biblioflow.sources.tables import read_table


def p2_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of the last 7 and 30 days for each reader's book and day, quiet days included."""
    book = strip_blanks(F.col("book"))
    rows = read_table(spark, sf_dir, "kindle_days").select("reader_id", book.alias("book"), "date", "reading_seconds").where("book != ''")
    return trailing_totals(rows, ["reader_id", "book"], "date", "reading_seconds")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at least 29 days after an entity's first on which 7 days hold 70 % or more of the last 30 days' total."""
    t = p2_trailing(spark, sf_dir)
    return t.where("day_number >= 29 and total_7 > 0 and 10 * total_7 >= 7 * total_30").select("reader_id", "book", "date")


_TRAILING_SQL = r"""
WITH kept AS (
  SELECT reader_id, regexp_replace(book, '^[\s\p{Z}\x{200b}\x{feff}]+|[\s\p{Z}\x{200b}\x{feff}]+$', '', 'g') AS book,
         try_cast(date AS DATE) AS d, floor(reading_seconds)::BIGINT AS v
  FROM kindle_days
  WHERE regexp_full_match(date, '\d{4}-\d{2}-\d{2}') AND try_cast(date AS DATE) IS NOT NULL
    AND reading_seconds >= 0 AND isfinite(reading_seconds)
), days AS (
  SELECT reader_id, book, d, max(v) AS v FROM kept WHERE book <> '' GROUP BY ALL
), spans AS (
  SELECT reader_id, book, min(d) AS first_day, max(d) AS last_day FROM days GROUP BY ALL
), calendar AS (
  SELECT reader_id, book, first_day, unnest(generate_series(first_day, last_day, INTERVAL 1 DAY))::DATE AS d FROM spans
), filled AS (
  SELECT c.reader_id, c.book, c.first_day, c.d, coalesce(x.v, 0) AS v FROM calendar c
  LEFT JOIN days x ON c.reader_id IS NOT DISTINCT FROM x.reader_id AND c.book = x.book AND c.d = x.d
), totals AS (
  SELECT reader_id, book, strftime(d, '%Y-%m-%d') AS date, (d - first_day)::BIGINT AS day_number, v::BIGINT AS day_value,
         sum(v) OVER (PARTITION BY reader_id, book ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS total_7,
         sum(v) OVER (PARTITION BY reader_id, book ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS total_30
  FROM filled
)
"""

QUERIES = {"p2_found": p2_found, "p2_trailing": p2_trailing}
ORACLE_SQL = {
    "p2_found": _TRAILING_SQL + "SELECT reader_id, book, date FROM totals WHERE day_number >= 29 AND total_7 > 0 AND 10 * total_7 >= 7 * total_30",
    "p2_trailing": _TRAILING_SQL + "SELECT reader_id, book, date, day_number, day_value, total_7, total_7 / 7.0 AS avg_7, total_30, total_30 / 30.0 AS avg_30 FROM totals",
}
