"""Queries on reading statistics: events as page-reading intervals of customers as books, and uploaded day records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.operators import reading, snapshot
from biblioflow.sources.tables import read_table

ENTITY = ["reader_id"]
ORDER = ["received_at", "generated_at", "reading_seconds"]
CUTOVER = 1_704_067_200


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of reading intervals; the value is minutes."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id_book"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start_time"), (F.col("value") * 60).alias("duration"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("authors"))


def stat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.intervals(log(spark, sf_dir), books(spark, sf_dir))


def stat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.sessions(stat_intervals(spark, sf_dir), CUTOVER)


def stat_period_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.period_days(stat_intervals(spark, sf_dir))


def stat_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = reading.day_statistics(stat_intervals(spark, sf_dir), CUTOVER)
    return days.withColumn("details", F.size("session_details")).drop("session_details")


def stat_newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.newest_sessions(stat_sessions(spark, sf_dir)).select("title", "author", "start_time", "reading_seconds")


def stat_last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = stat_sessions(spark, sf_dir).select("title", "author", "date", "session", "reading_seconds", (F.col("start_time") * 1000 + F.col("session")).alias("place"))
    return reading.last_per_group(done, ["title", "author"], "place", 5)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "kindle_days")


def snap_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["received_at", "book", "date", "reading_seconds", "sessions", "title", "author"]
    return snapshot.first_errors(_days(spark, sf_dir), ["reader_id", "generated_at"], order)


def snap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.reconciled_days(_days(spark, sf_dir), ENTITY, [*ORDER, "title", "author"])


def snap_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.reconciled_details(_days(spark, sf_dir), ENTITY, ORDER)


def snap_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot_json(snap_days(spark, sf_dir), F.lit("2024-01-01T00:00:00.000Z"))


_INTERVALS = r"""
WITH book AS (
  SELECT c_custkey AS id, coalesce(nullif(trim(c_name), ''), 'Unknown title') AS title, coalesce(nullif(trim(c_mktsegment), ''), '') AS author FROM customer
), iv AS (
  SELECT b.title, b.author, epoch(e.ts)::BIGINT - (CASE WHEN date_part('microsecond', e.ts) % 1000000 >= 500000 THEN 1 ELSE 0 END) AS start_time, floor(e.value * 60)::BIGINT AS duration
  FROM events e JOIN book b ON b.id = e.user_id
  WHERE e.value * 60 > 0 AND floor(e.value * 60) > 0
)"""
_SESSIONS = (
    _INTERVALS
    + r""", timed AS (
  SELECT *, start_time + duration AS end_time, strftime(make_timestamp(start_time * 1000000), '%Y-%m-%d') AS date FROM iv
), marked AS (
  SELECT *, max(end_time) OVER w AS latest FROM timed
  WINDOW w AS (PARTITION BY title, author, date ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), numbered AS (
  SELECT *, sum(CASE WHEN latest IS NULL OR start_time > latest + 1800 THEN 1 ELSE 0 END) OVER (
    PARTITION BY title, author, date ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM marked
), parts AS (
  SELECT *, unnest(generate_series(start_time - start_time % 86400, (end_time - 1) - (end_time - 1) % 86400, 86400)) AS d0 FROM numbered
), banded AS (
  SELECT *, d0 = start_time - start_time % 86400 AS first_part, strftime(make_timestamp(d0 * 1000000), '%Y-%m-%d') AS day,
    greatest(0, least(end_time, d0 + 46800) - greatest(start_time, d0 + 21600)) AS morning_seconds,
    greatest(0, least(end_time, d0 + 75600) - greatest(start_time, d0 + 46800)) AS afternoon_seconds,
    greatest(0, least(end_time, d0 + 21600) - greatest(start_time, d0)) + greatest(0, least(end_time, d0 + 86400) - greatest(start_time, d0 + 75600)) AS night_seconds
  FROM parts
), done AS (
  SELECT title, author, date, session, min(start_time) AS start_time, max(end_time) AS end_time, sum(CASE WHEN first_part THEN duration ELSE 0 END)::BIGINT AS reading_seconds,
    sum(morning_seconds)::BIGINT AS morning_seconds, sum(afternoon_seconds)::BIGINT AS afternoon_seconds, sum(night_seconds)::BIGINT AS night_seconds
  FROM banded GROUP BY ALL
), sess AS (
  SELECT *, reading_seconds >= 180 AS counted, reading_seconds >= 180 AND start_time >= 1704067200 AS timed FROM done
)"""
)
_BOOK = "title || CASE WHEN author <> '' THEN ' - ' || author ELSE '' END || '.epub'"
_VALID = r"""
WITH raw AS (
  SELECT *, trim(book, E' \t\n\r\x0b\x0c' || chr(160) || chr(8203) || chr(65279)) AS b, trim(date) AS dt FROM kindle_days
), checked AS (
  SELECT *, CASE
    WHEN b IS NULL OR b = '' THEN '.book must be a non-empty string' WHEN length(b) > 512 THEN '.book is too long'
    WHEN dt IS NULL OR dt = '' THEN 'date must be a non-empty string' WHEN length(dt) > 512 THEN 'date is too long'
    WHEN NOT regexp_full_match(dt, '\d{4}-\d{2}-\d{2}') THEN 'date must use YYYY-MM-DD'
    WHEN try_cast(dt AS DATE) IS NULL THEN 'invalid date: ' || dt
    WHEN reading_seconds IS NULL OR NOT isfinite(reading_seconds) OR reading_seconds < 0 THEN '.reading_seconds must be a non-negative number'
    WHEN sessions IS NULL OR NOT isfinite(sessions) OR sessions < 0 THEN '.sessions must be a non-negative number'
    WHEN NOT isfinite(morning_seconds) OR morning_seconds < 0 THEN '.morning_seconds must be a non-negative number'
    WHEN NOT isfinite(afternoon_seconds) OR afternoon_seconds < 0 THEN '.afternoon_seconds must be a non-negative number'
    WHEN NOT isfinite(night_seconds) OR night_seconds < 0 THEN '.night_seconds must be a non-negative number'
    WHEN len(list_filter(session_details, lambda s: s IS NULL OR s.start_time IS NULL OR NOT isfinite(s.start_time) OR s.start_time < 0 OR s.end_time IS NULL OR NOT isfinite(s.end_time) OR s.end_time < 0
      OR s.reading_seconds IS NULL OR NOT isfinite(s.reading_seconds) OR s.reading_seconds < 0 OR floor(s.start_time) = 0 OR floor(s.end_time) < floor(s.start_time) OR floor(s.reading_seconds) = 0)) > 0 THEN 'details'
    END AS err FROM raw
), valid AS (SELECT * FROM checked WHERE err IS NULL)"""

QUERIES = {f.__name__: f for f in (stat_intervals, stat_sessions, stat_period_days, stat_days, stat_newest_sessions, stat_last_sessions, snap_first_error, snap_days, snap_details, snap_json)}
ORACLE_SQL = {
    "stat_intervals": _INTERVALS + " SELECT title, author, start_time, duration FROM iv WHERE start_time > 0",
    "stat_sessions": _SESSIONS + " SELECT * FROM sess",
    "stat_period_days": _SESSIONS + " SELECT title, author, day, sum(morning_seconds)::BIGINT AS morning_seconds, sum(afternoon_seconds)::BIGINT AS afternoon_seconds, sum(night_seconds)::BIGINT AS night_seconds FROM banded GROUP BY ALL",
    "stat_days": _SESSIONS
    + f""", days AS (
      SELECT {_BOOK} AS book, title, author, date, reading_seconds, counted::INT AS sessions, 0 AS morning_seconds, 0 AS afternoon_seconds, 0 AS night_seconds, timed::INT AS details, start_time FROM sess
      UNION ALL SELECT {_BOOK}, title, author, day, 0, 0, morning_seconds, afternoon_seconds, night_seconds, 0, NULL FROM banded
    ) SELECT book, date, min(title) AS title, min(author) AS author, sum(reading_seconds)::BIGINT AS reading_seconds, sum(sessions)::BIGINT AS sessions, sum(morning_seconds)::BIGINT AS morning_seconds,
      sum(afternoon_seconds)::BIGINT AS afternoon_seconds, sum(night_seconds)::BIGINT AS night_seconds, sum(details)::INT AS details FROM days GROUP BY book, date""",
    "stat_newest_sessions": _SESSIONS + " SELECT title, author, start_time, reading_seconds FROM (SELECT *, rank() OVER (ORDER BY start_time DESC) AS r FROM sess WHERE timed) WHERE r <= 256",
    "stat_last_sessions": _SESSIONS
    + " SELECT title, author, date, session, reading_seconds, place FROM (SELECT *, start_time * 1000 + session AS place, row_number() OVER (PARTITION BY title, author ORDER BY start_time * 1000 + session DESC) AS r FROM sess) WHERE r <= 5",
    "snap_first_error": _VALID
    + r""", numbered AS (
      SELECT *, row_number() OVER (PARTITION BY reader_id, generated_at ORDER BY received_at NULLS FIRST, book NULLS FIRST, date NULLS FIRST, reading_seconds NULLS FIRST, sessions NULLS FIRST, title NULLS FIRST, author NULLS FIRST) - 1 AS pos FROM checked
    ) SELECT reader_id, generated_at, count(*) AS records, arg_min(CASE WHEN err LIKE '.%' THEN 'days[' || pos || ']' || err ELSE err END, CASE WHEN err IS NOT NULL THEN pos END) AS error FROM numbered GROUP BY reader_id, generated_at""",
    "snap_days": _VALID
    + r""" SELECT reader_id, b AS book, dt AS date, arg_min(nullif(trim(title), ''), (received_at, generated_at, reading_seconds, title, author)) FILTER (WHERE trim(title) <> '') AS title,
      arg_min(nullif(trim(author), ''), (received_at, generated_at, reading_seconds, title, author)) FILTER (WHERE trim(author) <> '') AS author, max(floor(reading_seconds))::BIGINT AS reading_seconds, max(floor(sessions))::BIGINT AS sessions,
      nullif(max(floor(morning_seconds)), 0)::BIGINT AS morning_seconds, nullif(max(floor(afternoon_seconds)), 0)::BIGINT AS afternoon_seconds, nullif(max(floor(night_seconds)), 0)::BIGINT AS night_seconds
      FROM valid GROUP BY ALL""",
    "snap_details": _VALID
    + r""", each AS (
      SELECT reader_id, b AS book, dt AS date, unnest(session_details) AS s, generate_subscripts(session_details, 1) AS k, received_at, generated_at, reading_seconds FROM valid
    ), best AS (
      SELECT reader_id, book, date, floor(s.start_time)::BIGINT AS start_time, arg_max(s, (floor(s.reading_seconds), received_at, generated_at, reading_seconds, k)) AS d FROM each GROUP BY ALL
    ) SELECT reader_id, book, date, start_time, floor(d.end_time)::BIGINT AS end_time, floor(d.reading_seconds)::BIGINT AS reading_seconds, coalesce(floor(d.morning_seconds), 0)::BIGINT AS morning_seconds,
      coalesce(floor(d.afternoon_seconds), 0)::BIGINT AS afternoon_seconds, coalesce(floor(d.night_seconds), 0)::BIGINT AS night_seconds
      FROM (SELECT *, row_number() OVER (PARTITION BY reader_id, book, date ORDER BY start_time DESC) AS r FROM best) WHERE r <= 512""",
}
