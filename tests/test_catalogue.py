from datetime import datetime

from pyspark.sql import functions as F

from biblioflow.operators import catalogue, identity, sync

LISTING = "key string, size long, uploaded timestamp, etag string, custom_metadata map<string,string>"


def listing(spark, *keys):
    return spark.createDataFrame([(k, 9, datetime(2024, 1, 1), None, None) for k in keys], LISTING)


def test_overlay(spark):
    rows = listing(spark, "books/a.epub", "books/b.epub", "small/b.epub", "small/c.epub", "books/x.txt")
    originals = catalogue.entries(catalogue.under(rows, "books/").where(catalogue.is_book(F.col("key"))), "books/", "https://l")
    variants = catalogue.entries(catalogue.under(rows, "small/"), "small/", "https://l")
    got = [(r.name, r.key) for r in catalogue.by_name(catalogue.overlay(originals, variants)).collect()]
    assert got == [("a.epub", "books/a.epub"), ("b.epub", "small/b.epub")]
    assert "token" not in originals.first().download_url


def test_feed_and_lists(spark):
    df = spark.createDataFrame([("books/a<b.EPUB", 1, datetime(2024, 1, 1), None, {"title": "T", "syncTitle": "", "author": "A&B"}), ("books/c.epub", 1, None, None, None)], LISTING)
    rows = {r.key: r for r in catalogue.feed(df, "https://l").collect()}
    assert rows["books/a<b.EPUB"].title == "" and "A&amp;B" in rows["books/a<b.EPUB"].entry and rows["books/c.epub"].title == "c" and rows["books/c.epub"].author is None
    assert catalogue.next_number(listing(spark, "w/w-007.bmp", "w/x.bmp"), "key", r"w-(\d+)\.bmp\z").first().next_number == 8
    assert catalogue.next_number(listing(spark), "key", r"w-(\d+)\.bmp\z").first().next_number == 0


def test_sync(spark):
    schema = "name string, key string, etag string, updated string, size long, download_url string, ok boolean"
    remote = spark.createDataFrame([("a", "a", "1", "u", 9, "x", True), ("b", "b", "", "u", 9, "x", True), ("c", "c", "1", "u", 9, "x", True), ("d", "d", "1", "u", 9, "x", False), ("..", "e", "1", "u", 9, "x", True), ("f", "f", "1", "u", 9, None, True), ("g", "g", "1", "u", 9, "x", True)], schema)
    stored = spark.createDataFrame([("a", "1"), ("b", "old"), ("z", "9")], "key string, version string")
    local = spark.createDataFrame([("a",), ("b",), ("g",)], "file_name string")
    status = sync.sync_status(remote, stored, local)
    assert {r.key: r.status for r in status.collect()} == {"a": "unchanged", "b": "updated", "c": "new", "d": "failed", "e": "failed", "f": "failed", "g": "updated"}
    assert {r.key: r.version for r in sync.next_versions(status, stored).collect()} == {"a": "1", "b": "u:9", "c": "1", "g": "1", "z": "9"}
    c = sync.sync_counts(status, "books").first()
    assert (c.remote, c.downloaded, c.updated, c.unchanged, c.failed) == (7, 3, 2, 1, 3)
    assert sync.file_count(local, "^[ab]$").first().files == 2


def test_identity(spark):
    uploads = spark.createDataFrame([(1, "h1", "Á b.epub", None), (2, "h2", "a  B.epub", "i"), (3, "h3", "x", "i"), (4, None, None, None), (5, "h5", "", "")], "upload_id long, source_hash string, original_name string, isbn string")
    index = spark.createDataFrame([("h1", "k2", "", "f"), ("h2", "gone", "v", "f"), ("h5", "k1", None, "")], "source_hash string, key string, variant_key string, file_name string")
    stored = spark.createDataFrame([("k1", 1, None, "A B.epub", None), ("k2", 2, "h9", None, "i")], "key string, at long, source_hash string, original_name string, isbn string")
    got = {r.upload_id: (r.key, r.matched_by) for r in identity.find_existing(uploads, index, stored).collect()}
    assert got == {1: ("k2", "index"), 2: ("k1", "name"), 3: ("k2", "isbn"), 4: (None, None), 5: (None, None)}
    assert identity.valid_index(index).where("source_hash = 'h1'").first().variant_key == "books_small/f"


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert sorted(map(tuple, catalogue.upsert(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_pages(spark):
    rows = catalogue.entries(listing(spark, *(f"books/{k}.epub" for k in range(25))), "books/", "https://l")
    got = catalogue.pages(rows, 10).collect()
    assert sum(r.entries for r in got) == 25 and len(got) <= 3 and all('"key":"books/' in r.body for r in got)
    assert catalogue.pages(rows.where("false")).collect() == []
    doc = spark.range(1).select(catalogue.feed_document("t", "i", "u", F.array(F.lit("<entry/>"))).alias("x")).first().x
    assert doc.endswith("<entry/></feed>")
