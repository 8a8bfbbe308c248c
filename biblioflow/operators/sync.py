"""What an incremental synchronisation has to do, and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.filename import device_file_name
from biblioflow.functions.text import present


def version(etag: Column, updated: Column, size: Column) -> Column:
    """The etag, or "updated:size" where it is missing or empty."""
    stand_in = F.concat(F.coalesce(updated, F.lit("")), F.lit(":"), F.coalesce(size.cast("string"), F.lit("")))
    return F.coalesce(present(etag), stand_in)


def sync_status(remote: DataFrame, stored: DataFrame, local: DataFrame, pattern: str | None = None) -> DataFrame:
    """(key, name, version, status) of each remote entry (name, key, etag, updated, size, download_url, ok).

    failed: no storable name or address, a name outside `pattern`, or a download that isn't `ok`; new: no local file;
    updated: a local file with another stored version, or none; unchanged otherwise. Objects deleted remotely stay.
    `stored` has (key, version) with unique keys, `local` (file_name).
    """
    rows = remote.withColumns({"name": device_file_name(F.col("name")), "version": version(F.col("etag"), F.col("updated"), F.col("size"))})
    known = rows.join(stored.select("key", F.col("version").alias("__stored")), "key", "left")
    there = local.select(F.col("file_name").alias("name"), F.lit(True).alias("__there")).distinct()
    both = known.join(there, "name", "left")
    usable = F.col("name").isNotNull() & present(F.col("download_url")).isNotNull()
    if pattern:
        usable = usable & F.lower("name").rlike(pattern)
    same = F.col("__there").isNotNull() & F.col("__stored").eqNullSafe(F.col("version"))
    status = F.when(~usable, "failed").when(same, "unchanged").when(~F.coalesce("ok", F.lit(False)), "failed").when(F.col("__there").isNotNull(), "updated").otherwise("new")
    return both.select("key", "name", "version", status.alias("status"))


def next_versions(status: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, version) to store: the new version of what was downloaded, everything else as it was."""
    done = status.where(F.col("status").isin("new", "updated")).groupBy("key").agg(F.max("version").alias("version"))
    return stored.join(done.select("key"), "key", "left_anti").unionByName(done)


def sync_counts(status: DataFrame, kind: str) -> DataFrame:
    """(kind, remote, downloaded, updated, unchanged, failed): one row."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return status.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("remote"), count("new", "updated").alias("downloaded"), count("updated").alias("updated"), count("unchanged").alias("unchanged"), count("failed").alias("failed"))


def sync_errors(status: DataFrame, kind: str) -> DataFrame:
    """(kind, key, error): why each failed entry failed, its name (or key, if it has none) in front."""
    failed = status.where("status = 'failed'")
    return failed.select(F.lit(kind).alias("kind"), "key", F.concat_ws(": ", F.lit(kind), F.coalesce("name", "key"), F.when(F.col("name").isNull(), "no storable name").otherwise("not downloaded")).alias("error"))


def every_row_failed(status: DataFrame) -> DataFrame:
    """What a synchronisation gives whose folder can't be used: nothing is downloaded, every entry fails."""
    return status.withColumn("status", F.lit("failed"))


def file_count(files: DataFrame, pattern: str) -> DataFrame:
    """(files): how many names match, whatever their case."""
    return files.agg(F.count_if(F.lower("file_name").rlike(pattern)).alias("files"))
