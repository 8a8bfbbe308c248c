import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from biblioflow.functions.markup import package_metadata
from biblioflow.operators.reading import intervals, sessions
from biblioflow.sources import files
from biblioflow.streaming import jobs

OPF = '<package><metadata><dc:title>El faro</dc:title><dc:creator>Ana</dc:creator></metadata></package>'


def ebook(path="OEBPS/book.opf", named=True, mimetype=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if mimetype:
            z.writestr("mimetype", files.MIMETYPE)
        z.writestr("META-INF/container.xml", f'<rootfile full-path="{path if named else "gone.opf"}"/>')
        z.writestr(path, OPF)
        z.writestr("text.xhtml", "x" * 1000)
    return out.getvalue()


def test_ebooks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.EPUB").write_bytes(ebook())
    (tmp_path / "two.epub").write_bytes(ebook(named=False, mimetype=False))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "note.txt").write_text("x")
    assert files.file_listing(spark, str(tmp_path)).count() == 4
    rows = files.package_documents(files.ebooks(spark, str(tmp_path))).select("path", "error", package_metadata(F.col("opf"), 2026).alias("m")).collect()
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.m.title if r.m else None) for r in rows}
    assert got["one.EPUB"] == got["two.epub"] == (None, "El faro") and got["bad.epub"][0].startswith("not an archive")


def test_rebuilt():
    new = files.rebuilt(ebook(mimetype=False), {"title": "A & B"}, ["x"])
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        first = z.infolist()[0]
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and z.read("text.xhtml") == b"x" * 1000
        assert b"A &amp; B" in z.read("OEBPS/book.opf") and b"<dc:subject>x</dc:subject>" in z.read("OEBPS/book.opf")
    with pytest.raises(ValueError):
        out = io.BytesIO()
        zipfile.ZipFile(out, "w").close()
        files.rebuilt(out.getvalue(), {})


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "log.sqlite3")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE page_stat_data (id_book INTEGER, start_time INTEGER, duration REAL)")
        c.execute("CREATE TABLE book (id INTEGER, title TEXT, authors TEXT)")
        c.executemany("INSERT INTO page_stat_data VALUES (?, ?, ?)", [(1, 1_699_950_000 + 200 * k, 100.5) for k in range(50)])
        c.execute("INSERT INTO book VALUES (1, 'T', NULL)")
    spark.dataSource.register(files.SQLiteSource)
    scan = lambda t, **o: spark.read.format("sqlite").options(path=path, table=t, **o).load()
    log = scan("page_stat_data", partition_column="start_time", numPartitions="3")
    assert log.rdd.getNumPartitions() == 3 and log.count() == 50
    (one,) = sessions(intervals(log, scan("book"))).collect()
    assert one.reading_seconds == 5000 and one.counted
    with pytest.raises(Exception, match="no table"):
        scan("missing").count()


def test_attempts(spark):
    rows = spark.createDataFrame([(1, None, True), (2, 0, False), (3, 2, False), (4, 1, None)], "id int, attempts int, ok boolean")
    got = {r.id: (r.state, r.attempts, r.delay) for r in jobs.after_attempt(rows, "ok").collect()}
    assert got == {1: ("done", 1, None), 2: ("retry", 1, 10), 3: ("dead", 3, None), 4: ("retry", 2, 20)}


def test_queue_replay(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n, batch in enumerate([[("a", 1), ("b", 2)], [("b", 3), ("c", 4)]]):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in batch))
    run = lambda check: jobs.consume(spark, str(source), "k string, v int", str(tmp_path / check), lambda d: d, str(store), "k").awaitTermination()
    run("one")
    read = lambda: sorted((r.k, r.v) for r in spark.read.parquet(str(store)).collect())
    first = read()
    assert [k for k, _ in first] == ["a", "b", "c"]
    run("one")
    run("two")  # every job is delivered again
    assert [k for k, _ in read()] == ["a", "b", "c"]


def test_retries_and_dead_letters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BACK_OFF", 0)
    source, store, dead = tmp_path / "in", tmp_path / "store", tmp_path / "dead"
    source.mkdir()
    (source / "0.json").write_text("\n".join(json.dumps({"k": k}) for k in ("good", "late", "bad")) + "\n" + json.dumps({"k": "future", "not_before": "2999-01-01T00:00:00Z"}))
    ok = F.when(F.col("k") == "late", F.coalesce("attempts", F.lit(0)) >= 1).when(F.col("k") == "bad", F.lit(None)).otherwise(F.lit(True))
    for _ in range(3):
        jobs.consume_with_retries(spark, str(source), "k string, attempts int, not_before timestamp", str(tmp_path / "check"), lambda d: d.withColumn("ok", ok), str(store), str(dead), "k").awaitTermination()
    assert sorted((r.k, r.attempts) for r in spark.read.parquet(str(store)).collect()) == [("good", 1), ("late", 2)]
    assert [(r.k, r.attempts) for r in spark.read.parquet(str(dead)).collect()] == [("bad", 3)]


def test_recomputed(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "snapshot")
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(log)
        jobs.recomputed(spark, log, "id long", str(tmp_path / "check"), lambda d: d.agg(F.count("*").alias("n")), out).awaitTermination()
    assert spark.read.parquet(out).first().n == 7
