"""Object listings to manifests, book lists and feeds.

A listing has (key STRING, size BIGINT, uploaded TIMESTAMP, etag STRING, custom_metadata MAP<STRING, STRING>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.dates import iso_time

BOOK = ".epub"


def under(listing: DataFrame, *prefixes: str) -> DataFrame:
    """Objects whose key begins with one of the prefixes; the comparison reaches the scan."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("key").startswith(p)
    return listing.where(wanted)


def at_key(listing: DataFrame, key: str) -> DataFrame:
    """The object of one key, or no row; the comparison reaches the scan."""
    return listing.where(F.col("key") == key)


def is_book(key: Column) -> Column:
    """Whether a key ends with the book extension, in any case."""
    return F.lower(key).endswith(BOOK)


def download_url(base: str, path: str, key: Column) -> Column:
    """Address of an object, its key encoded as a query value; it carries no credentials."""
    return F.concat(F.lit(f"{base}{path}?key="), F.url_encode(key))


def entries(listing: DataFrame, prefix: str, base: str, path: str = "/download", now: Column | None = None) -> DataFrame:
    """(name, key, size, updated, etag, download_url) of a listing: the name is the key without its prefix, a missing
    upload time is `now`, a missing etag ''."""
    now = F.current_timestamp() if now is None else now
    return listing.select(
        F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key")).alias("name"), "key", "size",
        iso_time(F.coalesce("uploaded", now)).alias("updated"), F.coalesce("etag", F.lit("")).alias("etag"), download_url(base, path, F.col("key")).alias("download_url"),
    )


def overlay(originals: DataFrame, variants: DataFrame, name: str = "name") -> DataFrame:
    """Every original, replaced as a whole by the variant of the same name if there is one; other variants are dropped.

    Both sides have the same columns. Of several variants of one name the last by key holds; originals are kept as
    often as they occur, and those without a name are never replaced.
    """
    columns = originals.columns
    other = variants.groupBy(name).agg(F.max_by(F.struct(*columns), "key").alias("__v"))
    both = originals.select(F.col(name), F.struct(*columns).alias("__o")).join(other, name, "left")
    return both.select(F.coalesce("__v", "__o").alias("__x")).select("__x.*")


def by_name(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows in the order in which people sort names."""
    return rows.orderBy(F.collate(F.col(name), "UNICODE"), name)


def book_list(listing: DataFrame, prefix: str = "books/") -> DataFrame:
    """(key, name, size, etag, updated, metadata) of the books, in the order of the listing; no metadata is an empty map."""
    rows = under(listing, prefix).where(is_book(F.col("key")))
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        "key", F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key")).alias("name"), "size", "etag", iso_time(F.col("uploaded")).alias("updated"), F.coalesce("custom_metadata", empty).alias("metadata")
    )


def feed(listing: DataFrame, base: str, prefix: str = "books/") -> DataFrame:
    """(key, title, author, updated, entry): an Atom entry per book. The title is the one for syncing, else the book's,
    else the file's; an author that is missing or empty has no element."""
    m, name = F.col("metadata"), F.regexp_replace("name", r"(?i)\.epub\z", "")
    rows = book_list(listing, prefix).select("key", F.coalesce(m["syncTitle"], m["title"], name).alias("title"), F.coalesce(m["syncAuthor"], m["author"]).alias("author"), "updated")
    author = F.when(F.coalesce(F.col("author"), F.lit("")) != "", F.concat(F.lit("<author><name>"), xml_escape(F.col("author")), F.lit("</name></author>"))).otherwise("")
    parts = [
        F.lit("<entry><title>"), xml_escape(F.col("title")), F.lit("</title><id>"), xml_escape(F.concat(F.lit("urn:book:"), "key")), F.lit("</id><updated>"), F.col("updated"), F.lit("</updated>"), author,
        F.lit('<link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="'), xml_escape(download_url(base, "/download", F.col("key"))), F.lit('"/></entry>'),
    ]
    return rows.withColumn("entry", F.concat(*parts))


def pages(entries: DataFrame, size: int = 1_000) -> DataFrame:
    """(page INT, entries BIGINT, body STRING): JSON documents of about `size` entries, so that no listing however long
    becomes one row; a key is always on the same page of a listing of the same length."""
    count = entries.count()
    n = max(1, -(-count // size))
    page = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    listed = entries.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_list(F.struct("name", *(c for c in entries.columns if c != "name")))).alias("__list"))
    return listed.select("page", "entries", F.to_json(F.struct(F.col("__list").alias("entries"))).alias("body"))


def feed_document(title: str, ident: str, updated: str, entries: Column) -> Column:
    """An Atom document around the entries of a page."""
    head = f'<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{title}</title><id>{ident}</id><updated>{updated}</updated>'
    return F.concat(F.lit(head), F.array_join(entries, ""), F.lit("</feed>"))


def xml_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def next_number(keys: DataFrame, key: str, pattern: str) -> DataFrame:
    """(next_number BIGINT): one more than the largest number that `pattern`'s group finds in the keys, 0 if none does."""
    number = F.regexp_extract(key, pattern, 1).try_cast("bigint")
    return keys.agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next_number"))


def numbered_name(number: Column) -> Column:
    """A number with at least three digits."""
    return F.format_string("%03d", number)


def variant_metadata(fields: dict[str, Column], description: Column, sources: Column) -> Column:
    """String map of a stored book: fields cut to 500 characters, the description to 300, absent and empty ones left
    out, and where each came from as "field:source,..."."""
    cut = F.create_map(*(x for name, c in fields.items() for x in (F.lit(name), F.substring(c, 1, 500))), F.lit("descriptionPreview"), F.substring(description, 1, 300))
    kept = F.map_filter(cut, lambda _, v: F.coalesce(v != "", F.lit(False)))
    listed = F.array_join(F.transform(F.map_entries(sources), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return F.map_concat(kept, F.create_map(F.lit("metadataSources"), listed))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, a new one in place of an old one of equal key. The new keys are unique."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
