import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from biblioflow.operators import reading

SCHEMA = "title string, author string, start_time long, duration long"


def brute(rows, zone):
    """Sessions and seconds by period, interval by interval and minute bound by minute bound."""
    tz = ZoneInfo(zone)
    day = lambda t: datetime.fromtimestamp(t, tz).strftime("%Y-%m-%d")
    done, bands, current = [], {}, None
    for title, author, start, duration in sorted(rows):
        key = (title, author, day(start))
        if current and (current[0] != key or start > current[2] + 1800):
            done.append(current)
            current = None
        current = [key, start, start + duration, duration] if current is None else [key, current[1], max(current[2], start + duration), current[3] + duration]
        for t in range(start, start + duration):
            h = datetime.fromtimestamp(t, tz).hour
            k = (title, author, day(t))
            bands.setdefault(k, [0, 0, 0])[0 if 6 <= h < 13 else 1 if 13 <= h < 21 else 2] += 1
    return sorted([(*k, s, e, d) for k, s, e, d in [*done, *([current] if current else [])]]), bands


@pytest.mark.parametrize("zone", ["UTC", "Europe/Madrid"])
def test_equals_brute_force(spark, zone):
    r = random.Random(7)
    base = int(datetime(2024, 3, 30, 12, tzinfo=timezone.utc).timestamp())  # the clocks change in the night after
    rows = sorted({(r.choice("ab"), "", base + r.randrange(0, 90_000, 300), r.choice([60, 200, 400, 5000])) for _ in range(60)})
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        want, bands = brute(rows, zone)
        got = reading.sessions(df).collect()
        assert sorted((x.title, x.author, x.date, x.start_time, x.end_time, x.reading_seconds) for x in got) == want
        assert {(x.title, x.author, x.day): [x.morning_seconds, x.afternoon_seconds, x.night_seconds] for x in reading.period_days(df).collect()} == bands
        assert sum(sum(b) for b in bands.values()) == sum(x[3] for x in rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_vectors(spark):
    at = lambda h, m: int(datetime(2024, 5, 1, h, m, tzinfo=timezone.utc).timestamp())
    rows = [("T", "A", at(9, 0), 120), ("T", "A", at(9, 32), 100), ("T", "A", at(10, 10), 60), ("N", "", at(23, 50), 1200)]
    days = {(d.book, d.date): d for d in reading.day_statistics(spark.createDataFrame(rows, SCHEMA)).collect()}
    d = days["T - A.epub", "2024-05-01"]
    assert (d.reading_seconds, d.sessions, d.morning_seconds, len(d.session_details)) == (280, 1, 280, 1)
    n, m = days["N.epub", "2024-05-01"], days["N.epub", "2024-05-02"]
    assert (n.reading_seconds, n.sessions, n.night_seconds, m.reading_seconds, m.sessions, m.night_seconds) == (1200, 1, 600, 0, 0, 600)
    assert n.session_details[0].night_seconds == 1200


def test_dirty_intervals(spark):
    log = spark.createDataFrame([(1, 10, 0.5), (1, 0, 5.0), (1, 10, None), (None, 10, 5.0), (2, 10, 5.9), (3, 10, 5.0), (2, 10, 5.9)], "id_book long, start_time long, duration double")
    books = spark.createDataFrame([(1, None, None), (2, " \0x ", " "), (None, "n", "n")], "id long, title string, authors string")
    assert [tuple(r) for r in reading.intervals(log, books).collect()] == [("x", "", 10, 5)] * 2
    empty = spark.createDataFrame([], SCHEMA)
    assert reading.day_statistics(empty).collect() == [] and reading.newest_sessions(reading.sessions(empty)).collect() == []


def test_newest_keeps_ties(spark):
    done = spark.createDataFrame([(1, True), (2, True), (2, True), (3, True), (9, False)], "start_time long, timed boolean")
    assert sorted(r.start_time for r in reading.newest_sessions(done, 2).collect()) == [2, 2, 3]
