"""Rolling totals over trailing periods, quiet days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"(?U)\A[\s\u200b\ufeff]+|[\s\u200b\ufeff]+\z"


def strip_blanks(c: Column) -> Column:
    """`c` without surrounding blanks of any kind (trim() removes spaces only)."""
    return F.regexp_replace(c, BLANKS, "")


def existing_day(c: Column) -> Column:
    """The DATE of a `YYYY-MM-DD` string, or null if it has another form or isn't a day of the calendar."""
    return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def daily_values(rows: DataFrame, entity: Sequence[str], date: str, value: str) -> DataFrame:
    """One row per entity and day: (*entity, __day INT, __v BIGINT), the largest floored value of the day.

    Rows count if the date exists and the value is finite and not negative. Repeated uploads of a day are
    reduced before the shuffle, so a hot entity never moves more than its distinct days per task.
    """
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf")))
    return (
        rows.select(*entity, F.unix_date(existing_day(F.col(date))).alias("__day"), F.when(ok, F.floor(v)).alias("__v"))
        .where("__day is not null and __v is not null")
        .groupBy(*entity, "__day")
        .agg(F.max("__v").alias("__v"))
    )


def trailing_totals(rows: DataFrame, entity: Sequence[str], date: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For each entity and calendar day from its first to its last counted day: the day's value and, for each
    period of n days ending with it, `total_n` and `avg_n` (the total over n, quiet days counting as 0).

    Each daily total is exploded onto the output dates it influences (its own and the next max(periods) - 1) and
    on to the next counted day, which makes the calendar's rows of 0; entity and date then group them. Everything
    after the first aggregation runs on one partitioning by entity.
    Result columns: *entity, date STRING, day_number (days since the entity's first) and day_value BIGINT, total_n BIGINT, avg_n DOUBLE; other columns of `rows` are
    ignored whatever their names. An entity may hold nulls (null is then a value like any other); no counted row
    gives no result; ties and repeated rows count once.
    """
    far = max(periods)
    # A day has one row per entity by now, so an entity's rows are bounded by the calendar, and hashing by entity is safe.
    days = daily_values(rows, entity, date, value).repartition(*entity)
    each = Window.partitionBy(*entity).orderBy("__day")
    whole = Window.partitionBy(*entity)
    spans = days.withColumns({"__next": F.lead("__day").over(each), "__first": F.min("__day").over(whole), "__last": F.max("__day").over(whole)})
    until = f"greatest(least(__day + {far - 1}, __last), coalesce(__next - 1, __last))"
    influence = spans.select(*entity, "__first", "__v", F.posexplode(F.expr(f"sequence(__day, {until})")).alias("__lag", "__out"))
    total = influence.groupBy(*entity, "__out")
    sums = [F.sum(F.when(F.col("__lag") < n, F.col("__v")).otherwise(0)).alias(f"total_{n}") for n in periods]
    out = total.agg(F.min("__first").alias("__first"), F.sum(F.when(F.col("__lag") == 0, F.col("__v")).otherwise(0)).alias("day_value"), *sums)
    return out.select(
        *entity,
        F.date_format(F.date_from_unix_date("__out"), "yyyy-MM-dd").alias("date"),
        (F.col("__out") - F.col("__first")).cast("bigint").alias("day_number"),
        "day_value",
        *(c for n in periods for c in (F.col(f"total_{n}"), (F.col(f"total_{n}") / n).alias(f"avg_{n}"))),
    )
