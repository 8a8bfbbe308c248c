"""Which stored book an uploaded file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.text import normalize_file_name, present


def variant_key(variant: Column, file_name: Column, prefix: str = "books_small/") -> Column:
    """The stored key of a book's variant; one made from the file's name if it is missing or empty."""
    return F.coalesce(present(variant), F.concat(F.lit(prefix), file_name))


def valid_index(index: DataFrame) -> DataFrame:
    """Index rows (source_hash, key, variant_key, file_name) with a key and a file name."""
    ok = index.where(present(F.col("key")).isNotNull() & present(F.col("file_name")).isNotNull())
    return ok.withColumn("variant_key", variant_key(F.col("variant_key"), F.col("file_name")))


def find_existing(uploads: DataFrame, index: DataFrame, stored: DataFrame) -> DataFrame:
    """(upload_id, key, matched_by): the stored book of each upload (upload_id, source_hash, original_name, isbn).

    The index holds if the book it names is still stored. Otherwise the first stored book, in the order of the listing
    (`at`), that has the same hash or the same original name in normal form, and only if there is none, the first of
    the same ISBN: three equi-joins whose hits are reduced to the first before they meet. Nulls and empty values match nothing; an upload without a match
    has null. `stored` has (key, at, source_hash, original_name, isbn).
    """
    up = uploads.withColumn("__name", present(normalize_file_name(F.col("original_name"))))
    books = stored.withColumn("__name", present(normalize_file_name(F.col("original_name"))))
    alive = valid_index(index).join(stored.select("key").distinct(), "key", "left_semi").groupBy("source_hash").agg(F.min("key").alias("__indexed"))
    firsts = None
    for column, label in (("source_hash", "hash"), ("__name", "name"), ("isbn", "isbn")):
        keyed = books.where(present(F.col(column)).isNotNull()).groupBy(column).agg(F.min(F.struct("at", "key")).alias("__first"))
        hit = up.select("upload_id", F.col(column)).where(present(F.col(column)).isNotNull()).join(keyed, column).select("upload_id", F.col("__first.at").alias("at"), F.col("__first.key").alias("key"), F.lit(label).alias("by"))
        firsts = hit if firsts is None else firsts.unionByName(hit)
    order = {"hash": 0, "name": 1, "isbn": 2}
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("by")]
    best = firsts.groupBy("upload_id").agg(F.min(F.struct((F.col("by") == "isbn").alias("retry"), "at", rank.alias("rank"), "key", "by")).alias("__b"))
    found = up.join(alive, "source_hash", "left").join(best, "upload_id", "left")
    return found.select("upload_id", F.coalesce("__indexed", "__b.key").alias("key"), F.when(F.col("__indexed").isNotNull(), "index").otherwise(F.col("__b.by")).alias("matched_by"))
