import random
from datetime import date, timedelta

from biblioflow.operators.trailing import strip_blanks, trailing_totals
from pyspark.sql import functions as F

SCHEMA = "reader long, book string, date string, seconds double, total_7 string"


def brute(rows):
    best = {}
    for reader, book, day, seconds, _ in rows:
        try:
            d = date.fromisoformat(day) if day and len(day) == 10 else None
        except ValueError:
            d = None
        if d and seconds is not None and seconds == seconds and 0 <= seconds < float("inf"):
            k = (reader, book)
            best.setdefault(k, {})
            best[k][d] = max(best[k].get(d, 0), int(seconds))
    out = set()
    for (reader, book), days in best.items():
        d, last, first = min(days), max(days), min(days)
        while d <= last:
            t = [sum(days.get(d - timedelta(k), 0) for k in range(n)) for n in (7, 30)]
            out.add((reader, book, d.isoformat(), (d - first).days, days.get(d, 0), t[0], round(t[0] / 7, 6), t[1], round(t[1] / 30, 6)))
            d += timedelta(1)
    return out


def test_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, None]), r.choice(["a", "b", None]), (date(2024, 1, 1) + timedelta(r.randrange(150))).isoformat(), r.choice([10.0, 20.5, 3.9, 0.0]), "clash") for _ in range(120)]
    rows += rows[:10]
    rows += [(1, "a", "2024-02-30", 5.0, ""), (1, "a", "2024-2-3", 5.0, ""), (1, "a", None, 5.0, None), (1, "a", "2024-01-05", None, ""), (1, "a", "2024-01-06", float("nan"), ""), (1, "a", "2024-01-07", float("inf"), ""), (1, "a", "2024-01-08", -1.0, ""), (9, "z", "2024-01-01", -1.0, "")]
    got = trailing_totals(spark.createDataFrame(rows, SCHEMA), ["reader", "book"], "date", "seconds").collect()
    assert {(x.reader, x.book, x.date, x.day_number, x.day_value, x.total_7, round(x.avg_7, 6), x.total_30, round(x.avg_30, 6)) for x in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_empty_table(spark):
    assert trailing_totals(spark.createDataFrame([], SCHEMA), ["reader", "book"], "date", "seconds").collect() == []


def test_blanks(spark):
    row = spark.range(1).select(strip_blanks(F.lit(" \t  a b　\n")).alias("x")).first()
    assert row.x == "a b"
