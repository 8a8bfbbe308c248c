"""Calendar days, times of day and publication dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioflow.functions.text import bind, clean_text, trim_all

# Hours at which the morning, the afternoon and the night begin.
MORNING, AFTERNOON, NIGHT = 6, 13, 21
# Written-out dates that are understood besides year, year-month and day.
WRITTEN = ["MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy/M/d", "MMMM yyyy", "MMM yyyy"]


def period_of(hour: Column) -> Column:
    """morning (6 to 12), afternoon (13 to 20) or night."""
    return F.when((hour >= MORNING) & (hour < AFTERNOON), "morning").when((hour >= AFTERNOON) & (hour < NIGHT), "afternoon").otherwise("night")


def local_date(seconds: Column) -> Column:
    """Day of an epoch time in the session's time zone."""
    return F.from_unixtime(seconds, "yyyy-MM-dd")


def plausible_publication_date(c: Column, year: int) -> Column:
    """Whether a text is a year, a month or an existing day from the year 1000 to two years after `year`, without a time."""
    def parts(text: Column) -> Column:
        number = lambda at, n: F.substring(text, at, n).try_cast("int")
        return F.when(text.rlike(r"\A\d{4}(-\d{2}(-\d{2})?)?\z"), F.struct(number(1, 4).alias("y"), F.coalesce(number(6, 2), F.lit(1)).alias("m"), F.coalesce(number(9, 2), F.lit(1)).alias("d")))

    def possible(p: Column) -> Column:
        first = F.try_to_date(F.format_string("%04d-%02d-01", p["y"], F.when(p["m"].between(1, 12), p["m"])), "yyyy-MM-dd")
        return p["y"].between(1000, year + 2) & p["m"].between(1, 12) & p["d"].between(1, F.dayofmonth(F.last_day(first)))

    return F.coalesce(bind(bind(trim_all(F.coalesce(c, F.lit(""))), parts), possible), F.lit(False))


def normalize_publication_date(c: Column, year: int) -> Column:
    """A publication date as year, year-month or day: kept if it is one and plausible, else read from one of the
    written-out forms, else the first year from 1000 to 2099 in the text. `year` is the current one."""

    def full(text: Column) -> Column:
        day = F.coalesce(*(F.try_to_date(text, f) for f in WRITTEN), F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}T"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")))
        return F.date_format(day, "yyyy-MM-dd")

    def first_year(text: Column) -> Column:
        return F.regexp_extract(text, r"(?<![0-9A-Za-z_])(1\d{3}|20\d{2})(?![0-9A-Za-z_])", 1)

    def kept(found: Column) -> Column:
        return bind(found, lambda d: F.when(plausible_publication_date(d, year), d))

    strict = r"\A\d{4}(-\d{2})?(-\d{2})?\z"
    return bind(clean_text(c), lambda text: F.when(text.rlike(strict), kept(text)).otherwise(F.coalesce(kept(full(text)), kept(first_year(text)))))


def epoch_millis_date(c: Column) -> Column:
    """Day of an epoch time in milliseconds, in UTC."""
    return F.date_format(F.to_timestamp_ntz(F.date_from_unix_date(F.floor(c / 86_400_000).cast("int"))), "yyyy-MM-dd")


def iso_time(c: Column) -> Column:
    """A timestamp as 2024-01-31T08:00:00.000Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_or_now(c: Column, now: Column) -> Column:
    """An ISO-8601 time in UTC, or that of `now` where the text is none."""
    return iso_time(F.coalesce(F.try_to_timestamp(c), now))
