"""Queries on catalogues and synchronisation: book metadata as stored objects, one original per file with an e-book
record and one small variant per file that goodreads knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.operators import catalogue, identity, sync
from biblioflow.sources.tables import read_table

BASE = "https://library.example"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of both prefixes, with a string map of metadata."""
    b = read_table(spark, sf_dir, "book_metadata").select("source_hash", "source", "record_id", "title", "author", "isbn", "loaded_at")
    out = None
    for prefix, source, suffix in (("books/", "epub", ".EPUB"), ("books_small/", "goodreads", ".epub")):
        one = b.where(F.col("source") == source).groupBy("source_hash").agg(F.max_by(F.struct("record_id", "title", "author", "isbn", "loaded_at"), F.struct("loaded_at", "record_id")).alias("r"))
        meta = F.map_filter(F.create_map(F.lit("title"), F.col("r.title"), F.lit("author"), F.col("r.author"), F.lit("isbn"), F.col("r.isbn")), lambda _, v: v.isNotNull())
        rows = one.select(
            F.concat(F.lit(prefix), "source_hash", F.lit(suffix if source == "goodreads" else ".epub")).alias("key"), (F.col("r.record_id") * 1000).alias("size"), F.col("r.loaded_at").alias("uploaded"),
            F.when(F.col("r.record_id") % 3 != 0, F.concat(F.lit("e"), F.col("r.record_id").cast("string"))).alias("etag"), meta.alias("custom_metadata"), "source_hash",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def cat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.under(listing(spark, sf_dir), "books/").where(catalogue.is_book(F.col("key")))
    return catalogue.by_name(catalogue.entries(rows, "books/", BASE))


def cat_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir)
    originals = catalogue.entries(catalogue.under(rows, "books/"), "books/", BASE)
    variants = catalogue.entries(catalogue.under(rows, "books_small/"), "books_small/", BASE)
    return catalogue.by_name(catalogue.overlay(originals, variants))


def cat_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.book_list(listing(spark, sf_dir))
    return rows.select("key", "name", "size", "etag", "updated", F.col("metadata")["title"].alias("title"), F.size("metadata").alias("facts"))


def cat_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.feed(listing(spark, sf_dir), BASE)


def cat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.under(listing(spark, sf_dir), "books/").where(catalogue.is_book(F.col("key")))
    return catalogue.pages(catalogue.entries(rows, "books/", BASE))


def cat_next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the next wallpaper, and the name it makes."""
    keys = read_table(spark, sf_dir, "search_documents").select(F.concat(F.lit("wallpapers/wallpaper-"), F.format_string("%03d", F.col("search_id") % 1_000_000), F.lit(".bmp")).alias("key"))
    return catalogue.next_number(keys, "key", r"wallpaper-(\d+)\.bmp\z").withColumn("next_name", catalogue.numbered_name(F.col("next_number")))


def _remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.entries(catalogue.under(listing(spark, sf_dir), "books/"), "books/", BASE)
    return rows.withColumn("ok", F.col("size") % 7000 != 0)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as the device last saw them: those of every fifth book are out of date, of every fourth missing."""
    r = _remote(spark, sf_dir).where("size % 4000 <> 0")
    return r.select("key", F.when(F.col("size") % 5000 == 0, "old").otherwise(sync.version(F.col("etag"), F.col("updated"), F.col("size"))).alias("version"))


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remote(spark, sf_dir).where("size % 6000 <> 0").select(F.col("name").alias("file_name"))


def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_status(_remote(spark, sf_dir), _stored(spark, sf_dir), _local(spark, sf_dir))


def sync_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.next_versions(sync_status(spark, sf_dir), _stored(spark, sf_dir))


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_counts(sync_status(spark, sf_dir), "books")


def cat_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-library and google-books records as uploads, looked up among the e-book records as stored books.

    A scenario: only every fifth stored book is in the index of uploads yet, by record_id; all of them are stored.
    """
    b = read_table(spark, sf_dir, "book_metadata").select("record_id", "source_hash", "source", "title", "isbn", "loaded_at")
    b = b.groupBy("record_id").agg(F.max_by(F.struct("source_hash", "source", "title", "isbn"), "loaded_at").alias("r")).select("record_id", "r.*")  # as last delivered
    key = F.concat(F.lit("books/"), F.col("record_id").cast("string"), F.lit(".epub"))
    stored = b.where("source = 'epub'").select(key.alias("key"), F.col("record_id").alias("at"), F.when(F.col("record_id") % 2 == 0, F.col("source_hash")).alias("source_hash"), F.col("title").alias("original_name"), "isbn")
    index = b.where("source = 'epub' and record_id % 5 = 0").select("source_hash", key.alias("key"), F.lit("").alias("variant_key"), F.concat(F.col("record_id").cast("string"), F.lit(".epub")).alias("file_name"))
    uploads = b.where("source in ('open-library', 'google-books')").select(F.col("record_id").alias("upload_id"), "source_hash", F.col("title").alias("original_name"), "isbn")
    return identity.find_existing(uploads, index, stored)


_LISTING = r"""
WITH one AS (
  SELECT source_hash, source, arg_max({'record_id': record_id, 'title': title, 'author': author, 'isbn': isbn, 'loaded_at': loaded_at}, (loaded_at, record_id)) AS r
  FROM book_metadata WHERE source IN ('epub', 'goodreads') GROUP BY ALL
), listing AS (
  SELECT CASE WHEN source = 'epub' THEN 'books/' ELSE 'books_small/' END || source_hash || '.epub' AS key, r.record_id * 1000 AS size, r.loaded_at AS uploaded,
    CASE WHEN r.record_id % 3 <> 0 THEN 'e' || r.record_id END AS etag, r, source, source_hash || '.epub' AS name FROM one
), entries AS (
  SELECT name, key, size, strftime(uploaded, '%Y-%m-%dT%H:%M:%S.%gZ') AS updated, coalesce(etag, '') AS etag,
    'https://library.example/download?key=' || replace(key, '/', '%2F') AS download_url, source, r FROM listing
), remote AS (SELECT *, size % 7000 <> 0 AS ok, coalesce(nullif(etag, ''), updated || ':' || size) AS version FROM entries WHERE source = 'epub'
), stored AS (SELECT key, CASE WHEN size % 5000 = 0 THEN 'old' ELSE version END AS version FROM remote WHERE size % 4000 <> 0
), status AS (
  SELECT r.key, r.name, r.version, CASE WHEN r.size % 6000 <> 0 AND s.version = r.version THEN 'unchanged' WHEN NOT r.ok THEN 'failed' WHEN r.size % 6000 <> 0 THEN 'updated' ELSE 'new' END AS status
  FROM remote r LEFT JOIN stored s USING (key)
)"""
_NAME = r"trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[\s\x{a0}]+', ' ', 'g'))"

QUERIES = {f.__name__: f for f in (cat_entries, cat_overlay, cat_books, cat_feed, cat_pages, cat_next_number, sync_status, sync_versions, sync_counts, cat_identity)}
ORACLE_SQL = {
    "cat_entries": _LISTING + " SELECT name, key, size, updated, etag, download_url FROM entries WHERE source = 'epub' ORDER BY name",
    "cat_overlay": _LISTING
    + """ SELECT coalesce(v.name, o.name) AS name, coalesce(v.key, o.key) AS key, coalesce(v.size, o.size) AS size, coalesce(v.updated, o.updated) AS updated, coalesce(v.etag, o.etag) AS etag,
      coalesce(v.download_url, o.download_url) AS download_url FROM entries o LEFT JOIN entries v ON v.source = 'goodreads' AND v.name = o.name WHERE o.source = 'epub'""",
    "cat_books": _LISTING
    + """ SELECT key, name, size, nullif(etag, '') AS etag, updated, r.title AS title, ((r.title IS NOT NULL)::INT + (r.author IS NOT NULL)::INT + (r.isbn IS NOT NULL)::INT) AS facts FROM entries WHERE source = 'epub'""",
    "cat_feed": _LISTING
    + """, facts AS (SELECT key, coalesce(r.title, regexp_replace(name, '(?i)\\.epub$', '')) AS title, r.author AS author, updated, download_url FROM entries WHERE source = 'epub')
      SELECT key, title, author, updated, '<entry><title>' || """
    + "{t}".replace("{t}", "replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')")
    + """ || '</title><id>urn:book:' || key || '</id><updated>' || updated || '</updated>' || CASE WHEN coalesce(author, '') <> '' THEN '<author><name>' || """
    + "replace(replace(replace(replace(replace(author, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
    + """ || '</name></author>' ELSE '' END || '<link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="' || download_url || '"/></entry>' AS entry FROM facts""",
    "cat_next_number": "SELECT coalesce(max(search_id % 1000000), -1)::BIGINT + 1 AS next_number, printf('%03d', coalesce(max(search_id % 1000000), -1)::BIGINT + 1) AS next_name FROM search_documents",
    "sync_status": _LISTING + " SELECT * FROM status",
    "sync_versions": _LISTING + " SELECT key, version FROM status WHERE status IN ('new', 'updated') UNION ALL SELECT key, version FROM stored WHERE key NOT IN (SELECT key FROM status WHERE status IN ('new', 'updated'))",
    "sync_counts": _LISTING
    + " SELECT 'books' AS kind, count(*) AS remote, count(*) FILTER (WHERE status IN ('new', 'updated')) AS downloaded, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'failed') AS failed FROM status",
    "cat_identity": rf"""
WITH b AS (SELECT *, nullif({_NAME}, '') AS name FROM book_metadata QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) = 1),
stored AS (SELECT 'books/' || record_id || '.epub' AS key, record_id AS at_, CASE WHEN record_id % 2 = 0 THEN source_hash END AS source_hash, name, nullif(isbn, '') AS isbn FROM b WHERE source = 'epub'),
idx AS (SELECT source_hash, min('books/' || record_id || '.epub') AS key FROM b WHERE source = 'epub' AND record_id % 5 = 0 GROUP BY 1),
up AS (SELECT record_id AS upload_id, source_hash, name, nullif(isbn, '') AS isbn FROM b WHERE source IN ('open-library', 'google-books')),
hits AS (
  SELECT upload_id, at_, 0 AS rank, key, 'hash' AS matched_by FROM up JOIN stored USING (source_hash)
  UNION ALL SELECT upload_id, at_, 1, key, 'name' FROM up JOIN stored USING (name)
  UNION ALL SELECT upload_id, at_, 2, key, 'isbn' FROM up JOIN stored USING (isbn)
), best AS (SELECT upload_id, arg_min(key, (rank = 2, at_, rank)) AS key, arg_min(matched_by, (rank = 2, at_, rank)) AS matched_by FROM hits GROUP BY 1)
SELECT upload_id, coalesce(i.key, best.key) AS key, CASE WHEN i.key IS NOT NULL THEN 'index' ELSE best.matched_by END AS matched_by
FROM up LEFT JOIN idx i USING (source_hash) LEFT JOIN best USING (upload_id)""",
}
