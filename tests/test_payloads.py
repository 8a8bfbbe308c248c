from pyspark.sql import functions as F

from biblioflow.functions.media import extension_of, media_type_of
from biblioflow.operators import catalogue, identity, resolve, sync
from biblioflow.sources import payloads


def test_media(spark):
    rows = [("a.JPEG", None, None, "jpg"), ("a", "b.webp", "image/png", "webp"), (None, None, "IMAGE/PNG", "png"), (None, None, None, "jpg"), ("a.gif", "b.png", None, "jpg"), ("", "", "text/plain", "jpg"), ("a.p-ng", None, "image/webp", "webp")]
    df = spark.createDataFrame(rows, "n string, p string, t string, want string").select("want", extension_of(F.col("n"), F.col("p"), F.col("t")).alias("e"))
    got = df.select("want", "e", media_type_of(F.col("e")).alias("m")).collect()
    assert all(r.want == r.e for r in got) and {r.m for r in got} == {"image/jpeg", "image/png", "image/webp"}


def test_manifest(spark):
    bodies = [None, "", "{", '{"books": [{"name": "a", "key": "k", "size": 1}]}', "{}", "[1"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r.d for r in df.select(payloads.decoded_manifest(F.col("body"), "struct<books:array<struct<name:string,key:string,size:bigint>>>").alias("d")).collect()]
    assert [d.error and d.error.split()[0] for d in got] == ["Server", "Server", "Could", None, None, "Could"]
    assert got[3].manifest.books[0].size == 1 and got[0].manifest is None and got[4].manifest.books is None


def test_top_details(spark):
    answers = spark.createDataFrame([("q", k, f"k{k}") for k in range(7)] + [("r", 1, None), ("r", 1, "k2"), (None, 1, "k1")], "query string, place int, key string")
    details = spark.createDataFrame([("k1", 10), ("k2", 20)], "key string, pages int")
    got = sorted((r["query"] or "", r.place_in_query, r.key or "", r.pages or 0) for r in payloads.top_details(answers, "query", "place", "key", details).collect())
    assert got == [("", 1, "k1", 10), ("q", 1, "k0", 0), ("q", 2, "k1", 10), ("q", 3, "k2", 20), ("q", 4, "k3", 0), ("r", 1, "", 0), ("r", 2, "k2", 20)]
    assert payloads.top_details(answers.where("false"), "query", "place", "key", details).collect() == []


def test_after_ranking(spark):
    hints = "struct<title:string,author:string,series:string,series_index:string>"
    rows = [
        (1, "lectulandia", "series", (None, None, "Saga azul", "2"), (None, None, "Saga azul", "02"), True), (2, "lectulandia", "series", (None, None, "Saga azul", "2"), (None, None, "Saga azul", "3"), False),
        (3, "lectulandia", "series", (None, None, "Saga azul", "2"), (None, None, "Otra cosa", "2"), False), (4, "lectulandia", "series", (None, None, "Saga azul", "2"), (None, None, None, None), False),
        (5, "google-books", "series", (None, None, "Saga azul", "2"), (None, None, "Otra cosa", "9"), True), (6, "lectulandia", "title", ("x", "Ana Ruiz", None, None), ("x", "Pedro Mar", None, None), False),
        (7, "lectulandia", "title", ("x", "Ana Ruiz", None, None), ("x", None, None, None), True), (8, "lectulandia", "title", ("x", "Ana Ruiz", None, None), ("x", "Luis Ruiz", None, None), True),
    ]
    df = spark.createDataFrame([(k, p, (kind, h), c, w) for k, p, kind, h, c, w in rows], f"k int, provider string, h struct<kind:string,hints:{hints}>, clean {hints}, want boolean")
    assert [r.k for r in df.where(resolve.kept_after_ranking() != F.col("want")).collect()] == []


def test_isbn_is_asked_last(spark):
    uploads = spark.createDataFrame([(1, "h", "a.epub", "i1"), (2, "x", "b.epub", "i1")], "upload_id int, source_hash string, original_name string, isbn string")
    stored = spark.createDataFrame([("k0", 0, None, None, "i1"), ("k1", 1, "h", None, None)], "key string, at int, source_hash string, original_name string, isbn string")
    index = spark.createDataFrame([], "source_hash string, key string, variant_key string, file_name string")
    assert {r.upload_id: (r.key, r.matched_by) for r in identity.find_existing(uploads, index, stored).collect()} == {1: ("k1", "hash"), 2: ("k0", "isbn")}


def test_errors_and_objects(spark):
    status = spark.createDataFrame([("k1", "a.epub", "v", "failed"), ("k2", None, "v", "failed"), ("k3", "c", "v", "new")], "key string, name string, version string, status string")
    assert {r.error for r in sync.sync_errors(status, "books").collect()} == {"books: a.epub: not downloaded", "books: k2: no storable name"}
    assert sync.sync_counts(sync.every_row_failed(status), "w").first().failed == 3
    assert [r.key for r in catalogue.at_key(status, "k3").collect()] == ["k3"] and catalogue.at_key(status, "none").collect() == []
