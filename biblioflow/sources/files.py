"""Files: listings, e-books and reading logs."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from biblioflow.functions.markup import rewrite_package

MOST_BYTES = 20 * 1024 * 1024  # of an e-book
MIMETYPE = b"application/epub+zip"


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, size, uploaded) of all files below a folder; their content isn't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded"))


def ebooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_hash, content) of the e-books below a folder that aren't too large."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.where((F.col("length") <= MOST_BYTES) & F.lower("path").endswith(".epub")).select("path", F.sha2("content", 256).alias("source_hash"), "content")


def _package(archive: zipfile.ZipFile) -> str | None:
    """Name of the package document: the one the container names if it exists, else the first of its kind."""
    import re

    names = archive.namelist()
    if "META-INF/container.xml" in names:
        found = re.search(r"""(?i)<rootfile\b[^>]*\bfull-path=["']([^"']+)["']""", archive.read("META-INF/container.xml").decode("utf-8", "replace"))
        if found and found[1] in names:
            return found[1]
    return next((n for n in names if n.lower().endswith(".opf")), None)


def package_documents(books: DataFrame) -> DataFrame:
    """(path, opf_path, opf, error) of e-books (path, content): their package documents. A file that is no archive or
    has no package document has an error instead."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = _package(z)
                        rows.append((path, name, z.read(name).decode("utf-8", "replace"), None) if name else (path, None, None, "no package document"))
                except (zipfile.BadZipFile, TypeError, KeyError) as e:
                    rows.append((path, None, None, f"not an archive: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "opf_path", "opf", "error"])

    return books.select("path", "content").mapInPandas(read, "path string, opf_path string, opf string, error string")


def rebuilt(content: bytes, fields: dict[str, str | None], subjects: list[str] | None = None) -> bytes:
    """An e-book with its package document rewritten: the media type first and stored, the rest compressed, read once
    more before it is returned."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as w:
        name = _package(z)
        if name is None:
            raise ValueError("no package document")
        w.writestr(zipfile.ZipInfo("mimetype"), z.read("mimetype") if "mimetype" in z.namelist() else MIMETYPE, zipfile.ZIP_STORED)
        for n in z.namelist():
            if n != "mimetype":
                data = rewrite_package(z.read(n).decode("utf-8"), fields, subjects).encode() if n == name else z.read(n)
                w.writestr(n, data, zipfile.ZIP_DEFLATED, 6)
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        if _package(z) != name:
            raise ValueError("the rebuilt file can't be read")
    return out.getvalue()


class SQLiteSource(DataSource):
    """Read-only scan of a SQLite table: options path, table, and partition_column for a scan in several ranges."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "TEXT": "string"}
        with _open(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{n}` {kinds.get((t or '').upper(), 'string')}" for _, n, t, *_ in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SQLiteReader(dict(self.options), [f.name for f in schema.fields])


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[InputPartition]:
        """Ranges of the partition column, each read by its own task."""
        n, column = int(self.options.get("numpartitions", 4)), self.options.get("partition_column")
        with _open(self.options["path"]) as c:
            low, high = c.execute(f"SELECT min({_quoted(column)}), max({_quoted(column)}) FROM {_quoted(self.options['table'])}").fetchone() if column else (None, None)
        if low is None:
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // n))
        return [_Range(x, min(high, x + step - 1)) for x in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        where, args = ("", ())
        if part.low is not None:
            where, args = f" WHERE {_quoted(self.options['partition_column'])} BETWEEN ? AND ?", (part.low, part.high)
        with _open(self.options["path"]) as c:
            yield from c.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.options['table'])}{where}", args)


def _open(path: str) -> sqlite3.Connection:
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    c.execute("PRAGMA query_only = ON")
    return c


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
