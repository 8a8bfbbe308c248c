"""Validation and reconciliation of uploaded day records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions.text import present, trim_all
from biblioflow.operators.trailing import existing_day

MOST_DAYS, MOST_DETAILS, LONGEST, MOST_BYTES = 20_000, 512, 512, 1 << 20
SECONDS = ["morning_seconds", "afternoon_seconds", "night_seconds"]
DETAIL = ["start_time", "end_time", "reading_seconds", *SECONDS]


def _bad_number(c: Column, optional: bool = False) -> Column:
    c = c.cast("double")
    bad = F.isnan(c) | (c < 0) | (c == float("inf"))
    return F.coalesce(bad, F.lit(not optional))


def whole(c: Column) -> Column:
    """A non-negative finite number floored, else null."""
    return F.when(~_bad_number(c), F.floor(c))


def text_error(c: Column, field: Column) -> Column:
    t = trim_all(c)
    return F.when(F.coalesce(t == "", F.lit(True)), F.concat(field, F.lit(" must be a non-empty string"))).when(F.length(t) > LONGEST, F.concat(field, F.lit(" is too long")))


def detail_error(details: Column, field: Column) -> Column:
    """The first error of a day's session details, in their order."""
    def of(d: Column, k: Column) -> Column:
        at = F.concat(field, F.lit("["), k.cast("string"), F.lit("]"))
        checks = [F.when(d.isNull(), F.concat(at, F.lit(" must be an object")))]
        checks += [F.when(_bad_number(d[n], n in SECONDS), F.concat(at, F.lit(f".{n} must be a non-negative number"))) for n in DETAIL]
        timing = (F.floor(d["start_time"]) == 0) | (F.floor(d["end_time"]) < F.floor(d["start_time"])) | (F.floor(d["reading_seconds"]) == 0)
        return F.coalesce(*checks, F.when(timing, F.concat(at, F.lit(" has invalid session timing"))))

    errors = F.array_compact(F.transform(details, of))
    return F.when(F.size(details) > MOST_DETAILS, F.concat(field, F.lit(" has too many entries"))).otherwise(F.try_element_at(errors, F.lit(1)))


def day_error(row: str = "days", index: Column | None = None) -> Column:
    """The first error of a day record (book, date, numbers, details in this order), or null if it is valid."""
    at = F.lit(row) if index is None else F.concat(F.lit(f"{row}["), index.cast("string"), F.lit("]"))
    field = lambda n: F.concat(at, F.lit(f".{n}"))
    date = trim_all(F.col("date"))
    return F.coalesce(
        text_error(F.col("book"), field("book")),
        text_error(F.col("date"), F.lit("date")),
        F.when(~date.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), "date must use YYYY-MM-DD"),
        F.when(existing_day(date).isNull(), F.concat(F.lit("invalid date: "), date)),
        *(F.when(_bad_number(F.col(n), n in SECONDS), F.concat(field(n), F.lit(" must be a non-negative number"))) for n in ("reading_seconds", "sessions", *SECONDS)),
        detail_error(F.col("session_details"), field("session_details")),
    )


def first_errors(days: DataFrame, snapshot: list[str], order: list[str]) -> DataFrame:
    """(*snapshot, records, error): the first error of each snapshot, or null if it is valid.

    Version, device and size come before the records, the records in the given order. A snapshot's records are
    numbered within it; more than MOST_DAYS make an error themselves. Nulls, NaN and infinite numbers are errors where
    a number is required, and nulls are 0 where it isn't.
    """
    number = F.row_number().over(Window.partitionBy(*snapshot).orderBy(*order)) - 1
    checked = days.withColumn("__at", number).withColumn("__error", day_error(index=F.col("__at")))
    head = F.when(~F.col("schema_version").eqNullSafe(1), "unsupported schema_version").when(~F.col("device").eqNullSafe("kindle"), 'device must be "kindle"')
    found = checked.withColumn("__head", head).groupBy(*snapshot).agg(
        F.count(F.lit(1)).alias("records"), F.min("__head").alias("__head"), F.min_by("__error", F.when(F.col("__error").isNotNull(), F.col("__at"))).alias("__error")
    )
    return found.select(*snapshot, "records", F.coalesce("__head", F.when(F.col("records") > MOST_DAYS, "too many day records"), "__error").alias("error"))


def reconciled_days(days: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """One row per (*entity, book, date) of the valid records: each number's largest value (never a sum), periods of 0
    as null, title and author the first that aren't blank in the given order. Map-side partial results, so repeated
    uploads of a hot day are no hot task."""
    valid = days.where(day_error().isNull())
    rank = F.struct(*order)
    first = lambda n: F.min_by(present(trim_all(F.col(n))), F.when(present(trim_all(F.col(n))).isNotNull(), rank)).alias(n)
    keyed = valid.withColumns({"book": trim_all(F.col("book")), "date": trim_all(F.col("date"))})
    return keyed.groupBy(*entity, "book", "date").agg(
        first("title"), first("author"), F.max(whole(F.col("reading_seconds"))).alias("reading_seconds"), F.max(whole(F.col("sessions"))).alias("sessions"),
        *(F.nullif(F.coalesce(F.max(whole(F.col(n))), F.lit(0)), F.lit(0)).alias(n) for n in SECONDS),
    )


def reconciled_details(days: DataFrame, entity: list[str], order: list[str], most: int = MOST_DETAILS) -> DataFrame:
    """Session details of the valid records, one per (*entity, book, date, start_time): the longest reading, the later
    of equals; of each day the last `most` by start."""
    valid = days.where(day_error().isNull())
    each = valid.select(*entity, trim_all(F.col("book")).alias("book"), trim_all(F.col("date")).alias("date"), F.struct(*order).alias("__order"), F.posexplode("session_details").alias("__k", "d"))
    # One maximum over a struct of fixed-width numbers; the order breaks ties in favour of the later upload.
    floored = each.select(*entity, "book", "date", "__order", "__k", *(F.coalesce(F.floor(F.col("d")[n]), F.lit(0)).alias(n) for n in DETAIL))
    best = floored.groupBy(*entity, "book", "date", "start_time").agg(F.max_by(F.struct("end_time", "reading_seconds", *SECONDS), F.struct("reading_seconds", "__order", "__k")).alias("d"))
    rank = F.row_number().over(Window.partitionBy(*entity, "book", "date").orderBy(F.desc("start_time")))
    return best.withColumn("__rank", rank).where(F.col("__rank") <= most).select(*entity, "book", "date", "start_time", "d.*")


def snapshot_json(days: DataFrame, generated_at: Column) -> DataFrame:
    """One JSON document per `reader_id` of its days by (date, book); absent values are left out.

    A document holds MOST_DAYS days at most, so no larger group is gathered: a reader with more has a null body.
    """
    counts = days.groupBy("reader_id").agg(F.count(F.lit(1)).alias("records"))
    days = days.join(counts.where(F.col("records") > MOST_DAYS).select("reader_id"), "reader_id", "left_anti")
    record = F.struct("date", F.collate("book", "UNICODE").alias("__sort"), "book", "title", "author", "reading_seconds", "sessions", *SECONDS)
    lists = days.groupBy("reader_id").agg(F.array_sort(F.collect_list(record)).alias("d"))
    plain = F.transform("d", lambda x: F.struct(x["book"].alias("book"), x["title"].alias("title"), x["author"].alias("author"), x["date"].alias("date"), *(x[n].alias(n) for n in ("reading_seconds", "sessions", *SECONDS))))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("kindle").alias("device"), generated_at.alias("generated_at"), plain.alias("days")))
    return counts.join(lists.select("reader_id", body.alias("body")), "reader_id", "left").select("reader_id", "records", "body")


def parsed_bodies(bodies: DataFrame, body: str, schema: str) -> DataFrame:
    """`bodies` with `parsed` and `error`: too large (counted in bytes), not JSON, or null."""
    parsed = F.from_json(F.col(body), schema)
    broken = F.try_parse_json(F.col(body)).isNull()
    error = F.when(F.octet_length(body) > MOST_BYTES, "Snapshot too large").when(broken, "Invalid JSON")
    return bodies.withColumns({"error": error, "parsed": F.when(error.isNull(), parsed)})


def or_empty(stored: Column) -> Column:
    """A stored snapshot document, or the empty one of the epoch if nothing is stored."""
    return F.coalesce(stored, F.lit('{"schema_version":1,"device":"kindle","generated_at":"1970-01-01T00:00:00.000Z","days":[]}'))
