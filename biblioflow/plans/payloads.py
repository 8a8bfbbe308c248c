"""Queries on raw records: the tables as the JSON that catalogues and servers send, taken apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions.dates import iso_or_now, period_of
from biblioflow.functions.language import MARKERS, is_spanish, language_code, looks_spanish
from biblioflow.functions.markup import links, package_metadata, package_path
from biblioflow.functions.media import extension_of, media_type_of
from biblioflow.operators import catalogue, sync
from biblioflow.plans.catalogue import _LISTING, listing, sync_status
from biblioflow.plans.texts import YEAR, _clean, _marks
from biblioflow.sources import payloads
from biblioflow.sources.tables import read_table

MANIFEST = "struct<books:array<struct<name:string,key:string,size:bigint>>>"


def _books(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return read_table(spark, sf_dir, "book_metadata").where(F.col("source") == source)


def _some(m: Column) -> list[Column]:
    return [m["title"].alias("title"), m["author"].alias("author"), m["language"].alias("language"), m["publisher"].alias("publisher"), m["page_count"].alias("page_count"), m["series_index"].alias("series_index"), F.size(m["subjects"]).alias("subjects")]


def src_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume records as JSON, mapped to book metadata."""
    info = F.struct(
        "title", F.array("author").alias("authors"), "description", "language", F.array(F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn").alias("identifier"))).alias("industryIdentifiers"), "publisher",
        F.col("published").alias("publishedDate"), F.col("page_count").alias("pageCount"), F.col("subjects").alias("categories"), F.struct(F.concat(F.lit("Book "), "series_index").alias("bookDisplayNumber")).alias("seriesInfo"),
    )
    body = F.to_json(F.struct(info.alias("volumeInfo")))
    return _books(spark, sf_dir, "google-books").select("record_id", payloads.volume_metadata(body, YEAR).alias("m")).select("record_id", *_some(F.col("m")))


def src_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search records mapped to book metadata."""
    rows = read_table(spark, sf_dir, "search_documents")
    m = payloads.work_metadata(F.col("title"), F.col("author_name"), F.col("language"), F.col("first_publish_year"), F.col("subject"))
    return rows.select("search_id", payloads.work_id(F.col("doc_key")).alias("work"), m.alias("m")).select("search_id", "work", F.col("m.title").alias("title"), F.col("m.author").alias("author"), F.col("m.language").alias("language"), F.col("m.published").alias("published"), F.size("m.subjects").alias("subjects"))


def src_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue pages with linked data, mapped to book metadata."""
    book = F.struct(F.lit("Book").alias("@type"), F.col("title").alias("name"), F.array(F.struct(F.col("author").alias("name"))).alias("author"), F.col("page_count").try_cast("bigint").alias("numberOfPages"), F.col("language").alias("inLanguage"))
    page = F.concat(F.lit('<html><script type="application/ld+json">{"@type": "WebSite"}</script><script type="application/ld+json">'), F.to_json(book), F.lit("</script></html>"))
    rows = _books(spark, sf_dir, "goodreads").where(~F.coalesce(F.concat_ws("", "title", "author", "language"), F.lit("")).contains("<"))
    return rows.select("record_id", payloads.linked_data_metadata(page).alias("m")).select("record_id", F.col("m.author").alias("author"), F.col("m.language").alias("language"), F.col("m.page_count").alias("page_count"))


def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each stored object, some of them empty or broken, decoded."""
    one = F.to_json(F.struct(F.array(F.struct(F.col("key").alias("name"), "key", "size")).alias("books")))
    body = F.when(F.col("size") % 7000 == 0, "").when(F.col("size") % 5000 == 0, F.substring(one, F.lit(1), F.length(one) - 2)).otherwise(one)
    rows = listing(spark, sf_dir).select("key", payloads.decoded_manifest(body, MANIFEST).alias("d"))
    return rows.select("key", "d.error", F.coalesce(F.size("d.manifest.books"), F.lit(-1)).alias("books"), F.element_at("d.manifest.books", 1)["size"].alias("size"))


def src_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four autocomplete items of each author, with the works of the same title."""
    items = read_table(spark, sf_dir, "autocomplete_items").select("item_id", F.col("author.id").alias("author_id"), F.coalesce("title", "book_title_bare").alias("title")).where("author_id is not null").distinct()
    works = read_table(spark, sf_dir, "search_documents").groupBy("title").agg(F.min("search_id").alias("search_id"))
    return payloads.top_details(items, "author_id", "item_id", "title", works).select("author_id", "place_in_query", "item_id", "search_id")


def cat_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored object, by its key."""
    rows = listing(spark, sf_dir)
    first = rows.agg(F.min("key")).first()[0]
    return catalogue.at_key(rows, first or "").select("key", "size", "etag")


def cat_variant_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept as strings with a stored book."""
    b = read_table(spark, sf_dir, "book_metadata")
    fields = {f: F.col(f) for f in ("title", "author", "publisher", "isbn")}
    m = catalogue.variant_metadata(fields, F.col("description"), F.create_map(F.lit("title"), F.coalesce("source", F.lit("none")), F.lit("isbn"), F.lit("epub")))
    return b.select("record_id", m.alias("m")).select("record_id", F.col("m")["title"].alias("title"), F.col("m")["publisher"].alias("publisher"), F.col("m")["descriptionPreview"].alias("preview"), F.col("m")["metadataSources"].alias("sources"), F.size("m").alias("kept"))


def sync_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of both synchronisations: that of the books, and one of wallpapers whose folder can't be used."""
    status = sync_status(spark, sf_dir)
    return sync.sync_errors(status, "books").unionByName(sync.sync_errors(sync.every_row_failed(status), "wallpapers"))


def sync_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both synchronisations."""
    status = sync_status(spark, sf_dir)
    return sync.sync_counts(status, "books").unionByName(sync.sync_counts(sync.every_row_failed(status), "wallpapers"))


def fn_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-letter codes of the labels of both tables."""
    one = read_table(spark, sf_dir, "book_metadata").select(F.col("language").alias("label"))
    other = read_table(spark, sf_dir, "search_documents").select(F.explode("language").alias("label"))
    codes = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("glg", "/languages/eus", "Spanish", "pt-BR", "xx")))).alias("label"))
    return one.unionByName(other).unionByName(codes).groupBy("label").count().select("label", "count", language_code(F.col("label")).alias("code"))


def fn_media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions and media types by the name, path or type of a file."""
    n = F.col("record_id") % 5
    name = F.when(n == 0, F.concat("source_hash", F.lit(".JPEG"))).when(n == 1, F.concat("source_hash", F.lit(".webp"))).when(n == 2, F.col("source_hash"))
    path = F.when(n == 3, F.concat(F.lit("photos/"), "source_hash", F.lit(".gif")))
    kind = F.when(F.col("record_id") % 3 == 0, "IMAGE/PNG").when(F.col("record_id") % 3 == 1, "text/plain")
    extension = extension_of(name, path, kind)
    return read_table(spark, sf_dir, "book_metadata").select("record_id", extension.alias("extension"), media_type_of(extension).alias("media_type"))


def src_spanish_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded metadata as hints for a Spanish edition: what holds of it in any language, and the rest if it is Spanish."""
    b = _books(spark, sf_dir, "epub")
    hints = payloads.for_spanish_edition(payloads.metadata(**{f: F.col(f) for f in payloads.FIELDS}), is_spanish(F.col("language")), looks_spanish(F.col("description")))
    m = F.col("m")
    return b.select("record_id", hints.alias("m")).select("record_id", m["title"].alias("title"), m["series"].alias("series"), m["language"].alias("language"), m["description"].alias("description"), m["publisher"].alias("publisher"), m["page_count"].alias("page_count"))


def src_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package documents of e-books, as their container names them, mapped to book metadata."""
    text = lambda name, c: F.coalesce(F.concat(F.lit(f"<dc:{name}>"), catalogue.xml_escape(c), F.lit(f"</dc:{name}>")), F.lit(""))
    meta = lambda name, c: F.coalesce(F.concat(F.lit('<meta content="'), catalogue.xml_escape(c), F.lit(f'" name="{name}"/>')), F.lit(""))
    subjects = F.array_join(F.transform(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: text("subject", s)), "")
    parts = [text("title", F.col("title")), text("creator", F.col("author")), text("language", F.col("language")), text("publisher", F.col("publisher")), text("identifier", F.col("isbn")), subjects]
    parts += [meta("page_count", F.col("page_count").cast("string")), meta("calibre:series", F.col("series")), meta("calibre:series_index", F.col("series_index"))]
    container = F.concat(F.lit('<container><rootfiles><rootfile media-type="x" full-path="OEBPS/'), "source_hash", F.lit('.opf"/></rootfiles></container>'))
    m, opf = F.col("m"), F.concat(F.lit("<package><metadata>"), *parts, F.lit("</metadata></package>"))
    rows = _books(spark, sf_dir, "epub").select("record_id", package_path(container).alias("path"), package_metadata(opf, YEAR).alias("m"))
    return rows.select("record_id", "path", m["title"].alias("title"), m["author"].alias("author"), m["language"].alias("language"), m["publisher"].alias("publisher"), m["page_count"].alias("page_count"), m["series"].alias("series"), F.size(m["subjects"]).alias("subjects"))


def src_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two different addresses of works that a page of a search record links to."""
    key = F.col("doc_key")
    parts = ['<a href="/about#top"><a class="x" href="', key, "\">x</a><A HREF='", key, "'><a href=\"/authors/OL1A\"><a href=\"", key, '/editions"><a href="', key, '/lists">']
    html = F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    return read_table(spark, sf_dir, "search_documents").select("search_id", F.array_join(links(html, r"/?works/"), "|").alias("links"))


def stat_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and part of the day."""
    e = read_table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), period_of(F.hour("ts")).alias("period"), "value")
    return e.groupBy("day", "period").agg(F.count(F.lit(1)).alias("events")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "period", "events")


def snap_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When snapshots were made, as uploaded, or a fixed time where that is no time."""
    at = iso_or_now(F.col("generated_at"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return read_table(spark, sf_dir, "kindle_days").groupBy("generated_at").agg(F.count(F.lit(1)).alias("days")).select("generated_at", "days", at.alias("at"))


_CODE = """CASE trim(regexp_replace(lower({x}), '^/languages/', '')) WHEN 'spa' THEN 'es' WHEN 'spanish' THEN 'es' WHEN 'eng' THEN 'en' WHEN 'english' THEN 'en' WHEN 'fre' THEN 'fr' WHEN 'fra' THEN 'fr' WHEN 'ger' THEN 'de' WHEN 'deu' THEN 'de'
  WHEN 'ita' THEN 'it' WHEN 'por' THEN 'pt' WHEN 'cat' THEN 'ca' WHEN 'glg' THEN 'gl' WHEN 'eus' THEN 'eu'
  ELSE CASE WHEN regexp_matches(trim(regexp_replace(lower({x}), '^/languages/', '')), '^[a-z]{{2}}-') THEN substr(trim(regexp_replace(lower({x}), '^/languages/', '')), 1, 2) ELSE trim(regexp_replace(lower({x}), '^/languages/', '')) END END"""
_NUMBER = r"nullif(replace(regexp_extract(series_index, '(\d+(?:[.,]\d+)?)', 1), ',', '.'), '')"
_ERRORS = " SELECT {k} AS kind, key, {k} || ': ' || coalesce(name, key) || ': ' || CASE WHEN name IS NULL THEN 'no storable name' ELSE 'not downloaded' END AS error FROM status"
_COUNTS = "SELECT 'books' AS kind, count(*) AS remote, count(*) FILTER (WHERE status IN ('new', 'updated')) AS downloaded, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'failed') AS failed FROM status"

QUERIES = {f.__name__: f for f in (src_volumes, src_works, src_linked_data, src_manifest, src_top_items, cat_object, cat_variant_metadata, sync_errors, sync_all, fn_language_codes, fn_media_types, src_packages, src_links, src_spanish_hints, stat_periods, snap_generated)}
ORACLE_SQL = {
    "src_volumes": f"""SELECT record_id, {_clean("title")} AS title, {_clean("author")} AS author, language, {_clean("publisher")} AS publisher, page_count, {_NUMBER} AS series_index,
      len(list_filter(subjects, lambda s: {_clean("s")} IS NOT NULL))::INT AS subjects FROM book_metadata WHERE source = 'google-books'""",
    "src_works": rf"""SELECT search_id, CASE WHEN regexp_full_match(trim(regexp_replace(regexp_replace(doc_key, '^/?works/', ''), '^/', '')), '(?i)OL\d+W') THEN trim(regexp_replace(regexp_replace(doc_key, '^/?works/', ''), '^/', '')) END AS work,
      {_clean("title")} AS title, {_clean("author_name[1]")} AS author, {_CODE.format(x="language[1]")} AS language, first_publish_year::VARCHAR AS published, len(list_filter(subject[1:12], lambda s: {_clean("s")} IS NOT NULL))::INT AS subjects FROM search_documents""",
    "src_linked_data": f"""SELECT record_id, {_clean("author")} AS author, {_CODE.format(x="language")} AS language, CASE WHEN isfinite(page_count) THEN trunc(page_count) END AS page_count FROM book_metadata WHERE source = 'goodreads' AND NOT contains(concat(title, author, language), '<')""",
    "src_manifest": _LISTING
    + """ SELECT key, CASE WHEN size % 7000 = 0 THEN 'Server returned an empty response' WHEN size % 5000 = 0 THEN 'Could not parse manifest JSON' END AS error,
      CASE WHEN size % 7000 = 0 OR size % 5000 = 0 THEN -1 ELSE 1 END AS books, CASE WHEN size % 7000 <> 0 AND size % 5000 <> 0 THEN size END AS size FROM listing""",
    "src_top_items": """
WITH i AS (SELECT DISTINCT item_id, author.id AS author_id, coalesce(title, book_title_bare) AS title FROM autocomplete_items WHERE author.id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY item_id, title NULLS FIRST) AS place_in_query FROM i), w AS (SELECT title, min(search_id) AS search_id FROM search_documents GROUP BY 1)
SELECT author_id, place_in_query::INT AS place_in_query, item_id, search_id FROM r LEFT JOIN w USING (title) WHERE place_in_query <= 4""",
    "cat_object": _LISTING + " SELECT key, size, etag FROM listing WHERE key = (SELECT min(key) FROM listing)",
    "cat_variant_metadata": """
SELECT record_id, nullif(substr(title, 1, 500), '') AS title, nullif(substr(publisher, 1, 500), '') AS publisher, nullif(substr(description, 1, 300), '') AS preview, 'title:' || coalesce(source, 'none') || ',isbn:epub' AS sources,
  (1 + (coalesce(title, '') <> '')::INT + (coalesce(author, '') <> '')::INT + (coalesce(publisher, '') <> '')::INT + (coalesce(isbn, '') <> '')::INT + (coalesce(description, '') <> '')::INT)::INT AS kept FROM book_metadata""",
    "sync_errors": _LISTING + _ERRORS.format(k="'books'") + " WHERE status = 'failed' UNION ALL" + _ERRORS.format(k="'wallpapers'"),
    "sync_all": _LISTING + " " + _COUNTS + " UNION ALL SELECT 'wallpapers', count(*), 0, 0, 0, count(*) FROM status",
    "fn_language_codes": f"""
WITH l AS (SELECT language AS label FROM book_metadata UNION ALL SELECT unnest(language) FROM search_documents UNION ALL SELECT unnest(['glg', '/languages/eus', 'Spanish', 'pt-BR', 'xx']))
SELECT label, count(*) AS count, {_CODE.format(x="label")} AS code FROM l GROUP BY label""",
    "src_packages": f"""
SELECT record_id, 'OEBPS/' || source_hash || '.opf' AS path, {_clean("title")} AS title, {_clean("author")} AS author, {_clean("language")} AS language, {_clean("publisher")} AS publisher, CASE WHEN page_count > 0 AND isfinite(page_count) THEN page_count END AS page_count,
  {_clean("series")} AS series, coalesce(len(list_filter(subjects, lambda s: {_clean("s")} IS NOT NULL)), 0)::INT AS subjects FROM book_metadata WHERE source = 'epub'""",
    "src_links": "SELECT search_id, CASE WHEN doc_key IS NOT NULL THEN CASE WHEN regexp_matches(doc_key, '/?works/') THEN doc_key || '|' || doc_key || '/editions' ELSE '' END END AS links FROM search_documents",
    "src_spanish_hints": f"""
WITH b AS (SELECT *, coalesce(trim(regexp_replace(lower(language), '^/languages/', '')) IN ('es', 'es-es', 'spa'), false) AS spanish FROM book_metadata WHERE source = 'epub')
SELECT record_id, title, series, 'es' AS language, CASE WHEN {_marks("description", MARKERS, 3)} THEN description END AS description, CASE WHEN spanish THEN publisher END AS publisher, CASE WHEN spanish THEN page_count END AS page_count FROM b""",
    "stat_periods": """
SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN hour(ts) BETWEEN 6 AND 12 THEN 'morning' WHEN hour(ts) BETWEEN 13 AND 20 THEN 'afternoon' ELSE 'night' END AS period, count(*) AS events FROM events GROUP BY 1, 2""",
    "snap_generated": """
SELECT generated_at, count(*) AS days, coalesce(strftime(try_cast(generated_at AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%gZ'), '2026-01-01T00:00:00.000Z') AS at FROM kindle_days GROUP BY 1""",
    "fn_media_types": """
WITH e AS (SELECT record_id, CASE record_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'webp' WHEN 3 THEN 'jpg' ELSE CASE WHEN record_id % 3 = 0 THEN 'png' ELSE 'jpg' END END AS extension FROM book_metadata)
SELECT record_id, extension, CASE extension WHEN 'jpg' THEN 'image/jpeg' ELSE 'image/' || extension END AS media_type FROM e""",
}
