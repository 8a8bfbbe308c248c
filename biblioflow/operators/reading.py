"""Reading intervals to sessions, times of day and daily statistics.

An interval is (title, author, start_time in epoch seconds, duration in seconds) of one reader's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions.dates import AFTERNOON, MORNING, NIGHT, local_date
from biblioflow.functions.text import clean_stats_text, stats_book_name

GAP = 30 * 60  # seconds without reading after which a new session begins
COUNTED = 3 * 60  # seconds from which on a session counts
NEWEST = 256  # timed sessions that a snapshot keeps
PERIODS = ["morning_seconds", "afternoon_seconds", "night_seconds"]


def intervals(log: DataFrame, books: DataFrame) -> DataFrame:
    """(title, author, start_time, duration): the positive intervals of a log (id_book, start_time, duration) of known
    books (id, title, authors). Durations are floored, and those that are then 0 are dropped; nulls and unknown books
    drop out, titles and authors are cleaned."""
    known = books.select(F.col("id").alias("__id"), clean_stats_text(F.col("title"), "Unknown title").alias("title"), clean_stats_text(F.col("authors"), "").alias("author"))
    rows = log.where("start_time > 0 and duration > 0").select("id_book", F.floor("start_time").alias("start_time"), F.floor("duration").alias("duration"))
    return rows.where("start_time > 0 and duration > 0").join(known, F.col("id_book") == F.col("__id")).select("title", "author", "start_time", "duration")


def with_sessions(rows: DataFrame, gap: int = GAP) -> DataFrame:
    """`rows` with `date`, the local day of the start, `end_time` and `session`, a number within (title, author, date).

    A session ends at the end of a local day, or when an interval begins more than `gap` seconds after the latest end
    so far. A book's day is what one task sorts.
    """
    timed = rows.withColumns({"date": local_date(F.col("start_time")), "end_time": F.col("start_time") + F.col("duration")})
    each = Window.partitionBy("title", "author", "date").orderBy("start_time", "end_time")
    latest = F.max("end_time").over(each.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (latest.isNull() | (F.col("start_time") > latest + gap)).cast("int")
    return timed.withColumn("__fresh", fresh).withColumn("session", F.sum("__fresh").over(each.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def _at(day: Column, hour: int) -> Column:
    return F.unix_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {hour:02d}:00:00"))))


def split_by_period(rows: DataFrame) -> DataFrame:
    """One row per interval and local day it touches: `day` and the seconds in its morning, afternoon and night.

    Bounds are local times of day, so a day of 23 or 25 hours keeps its bands.
    """
    first, last = local_date(F.col("start_time")).cast("date"), local_date(F.col("end_time") - 1).cast("date")
    each = rows.withColumn("__day", F.explode(F.sequence(first, last)))
    bounds = [_at(F.col("__day"), 0), _at(F.col("__day"), MORNING), _at(F.col("__day"), AFTERNOON), _at(F.col("__day"), NIGHT), _at(F.date_add("__day", 1), 0)]

    def inside(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end_time"), hi) - F.greatest(F.col("start_time"), lo))

    seconds = [inside(bounds[1], bounds[2]), inside(bounds[2], bounds[3]), inside(bounds[0], bounds[1]) + inside(bounds[3], bounds[4])]
    return each.withColumns({"day": F.col("__day").cast("string"), "__first": F.col("__day") == first, **dict(zip(PERIODS, seconds, strict=True))}).drop("__day")


def sessions(rows: DataFrame, cutover: int = 0, gap: int = GAP) -> DataFrame:
    """One row per session: title, author, date, start_time, end_time, reading_seconds, seconds by period, `counted`
    (180 seconds or more) and `timed` (counted and begun at the cutover or later)."""
    parts = split_by_period(with_sessions(rows, gap))
    out = parts.groupBy("title", "author", "date", "session").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum(F.when(F.col("__first"), F.col("duration")).otherwise(0)).alias("reading_seconds"), *(F.sum(p).alias(p) for p in PERIODS)
    )
    counted = F.col("reading_seconds") >= COUNTED
    return out.withColumns({"counted": counted, "timed": counted & (F.col("start_time") >= cutover)})


def period_days(rows: DataFrame) -> DataFrame:
    """Seconds by period of each (title, author, day), counted on the day on which they were read."""
    timed = rows.withColumn("end_time", F.col("start_time") + F.col("duration"))
    return split_by_period(timed).groupBy("title", "author", "day").agg(*(F.sum(p).alias(p) for p in PERIODS))


def day_statistics(rows: DataFrame, cutover: int = 0, gap: int = GAP) -> DataFrame:
    """One row per (book, date): reading_seconds and sessions by the day a session began, seconds by period by the day
    they were read (so a day may have only these), and the timed sessions. Books of equal name are one; their title
    and author are those of the first session. Days without anything positive don't occur."""
    done = sessions(rows, cutover, gap)
    detail = F.struct("start_time", "end_time", "reading_seconds", *PERIODS)
    by_session = done.select(
        stats_book_name(F.col("title"), F.col("author")).alias("book"), "title", "author", "date", "start_time", "reading_seconds", F.col("counted").cast("int").alias("sessions"), *(F.lit(0).cast("bigint").alias(p) for p in PERIODS), F.when(F.col("timed"), detail).alias("detail")
    )
    read = period_days(rows)
    no_time = F.lit(None).cast("bigint").alias("start_time")
    by_period = read.select(
        stats_book_name(F.col("title"), F.col("author")).alias("book"), "title", "author", F.col("day").alias("date"), no_time, F.lit(0).cast("bigint").alias("reading_seconds"), F.lit(0).alias("sessions"), *PERIODS, F.lit(None).cast(by_session.schema["detail"].dataType).alias("detail")
    )
    order = F.struct(F.coalesce("start_time", F.lit((1 << 62))), "title", "author")
    return (
        by_session.unionByName(by_period)
        .groupBy("book", "date")
        .agg(
            F.min_by("title", order).alias("title"), F.min_by("author", order).alias("author"), F.sum("reading_seconds").alias("reading_seconds"), F.sum("sessions").alias("sessions"),
            *(F.sum(p).alias(p) for p in PERIODS), F.array_sort(F.collect_list("detail")).alias("session_details"),
        )
    )


def newest_sessions(done: DataFrame, most: int = NEWEST) -> DataFrame:
    """The timed sessions whose start is among the `most` latest; all that share the earliest such start are kept.

    The cutoff is found by a distributed top-k, not by sorting all rows in one task.
    """
    timed = done.where("timed")
    cutoff = timed.select("start_time").orderBy(F.desc("start_time")).limit(most).agg(F.min("start_time").alias("__cutoff"))
    return timed.join(F.broadcast(cutoff), F.col("start_time") >= F.col("__cutoff")).drop("__cutoff")


def last_per_group(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The last `most` rows of each group by `order`, ties included up to that number."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
