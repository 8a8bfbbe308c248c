from datetime import datetime

from pyspark.sql import functions as F

from biblioflow.operators import snapshot

DETAIL = "struct<start_time:double,end_time:double,reading_seconds:double,morning_seconds:double,afternoon_seconds:double,night_seconds:double>"
SCHEMA = f"schema_version int, device string, reader_id long, generated_at string, book string, title string, author string, date string, reading_seconds double, sessions double, morning_seconds double, afternoon_seconds double, night_seconds double, session_details array<{DETAIL}>, received_at timestamp"


def day(n=0, **x):
    row = {"schema_version": 1, "device": "kindle", "reader_id": 1, "generated_at": "g", "book": "b", "title": None, "author": None, "date": "2024-01-01", "reading_seconds": 100.0, "sessions": 1.0, "morning_seconds": None, "afternoon_seconds": None, "night_seconds": None, "session_details": None, "received_at": datetime(2024, 1, 2, 0, n)}
    return tuple((row | x).values())


def test_first_error(spark):
    cases = {
        "none": [day()], "version": [day(schema_version=2, book="")], "device": [day(device=None)], "book": [day(), day(1, book=" ")], "long": [day(book="x" * 513)], "date": [day(date="2024-02-30")], "form": [day(date="2024-2-3")],
        "number": [day(reading_seconds=None)], "nan": [day(morning_seconds=float("nan"))], "detail": [day(session_details=[(1.0, 2.0, 1.0, None, None, None), (5.0, 2.0, 1.0, None, None, None)])], "null": [day(session_details=[None])],
    }
    rows = [r[:3] + (name,) + r[4:] for name, rs in cases.items() for r in rs]
    got = {r.generated_at: r.error for r in snapshot.first_errors(spark.createDataFrame(rows, SCHEMA), ["generated_at"], ["received_at"]).collect()}
    assert got == {
        "none": None, "version": "unsupported schema_version", "device": 'device must be "kindle"', "book": "days[1].book must be a non-empty string", "long": "days[0].book is too long", "date": "invalid date: 2024-02-30",
        "form": "date must use YYYY-MM-DD", "number": "days[0].reading_seconds must be a non-negative number", "nan": "days[0].morning_seconds must be a non-negative number",
        "detail": "days[0].session_details[1] has invalid session timing", "null": "days[0].session_details[0] must be an object",
    }


def test_reconciled(spark):
    d = lambda s, r: (float(s), float(s + r), float(r), 0.0, 0.0, None)
    rows = [day(0, sessions=1.0, reading_seconds=100.7, session_details=[d(5, 50), d(9, 10)]), day(1, sessions=3.0, reading_seconds=80.0, title=" ", morning_seconds=4.0, session_details=[d(5, 50)]), day(2, title="T"), day(3, title="U", book=" b "), day(4, book=None), day(5, reading_seconds=-1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    (one,) = snapshot.reconciled_days(df, ["reader_id"], ["received_at"]).collect()
    assert (one.book, one.title, one.reading_seconds, one.sessions, one.morning_seconds, one.night_seconds) == ("b", "T", 100, 3, 4, None)
    details = snapshot.reconciled_details(df, ["reader_id"], ["received_at"]).collect()
    assert sorted((x.start_time, x.reading_seconds) for x in details) == [(5, 50), (9, 10)]
    assert [x.start_time for x in snapshot.reconciled_details(df, ["reader_id"], ["received_at"], most=1).collect()] == [9]
    assert snapshot.reconciled_days(df.where("false"), ["reader_id"], ["received_at"]).collect() == []


def test_bodies(spark):
    rows = spark.createDataFrame([('{"schema_version":1}',), ("{bad",), ("x" * (1 << 20) + "x",), (None,)], "body string")
    got = [r.error for r in snapshot.parsed_bodies(rows, "body", "schema_version int").collect()]
    assert got[:3] == [None, "Invalid JSON", "Snapshot too large"]
    assert '"days":[]' in rows.select(snapshot.or_empty(F.lit(None).cast("string")).alias("x")).first().x
