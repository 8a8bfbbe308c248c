"""Queries on scalar functions over the whole metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.functions import dates, filename, isbn, language, scoring, series, text
from biblioflow.sources.tables import read_table

YEAR = 2026


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "book_metadata")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of a file beside the file's first record."""
    b = _books(spark, sf_dir).select("record_id", "source_hash", "title", "author", "language", "description", "series", "series_index").dropDuplicates(["record_id"])
    first = b.groupBy("source_hash").agg(F.min("record_id").alias("__first"))
    lead = b.join(first, (b["source_hash"] == first["source_hash"]) & (b["record_id"] == first["__first"]), "left_semi")
    return b.join(lead.select("source_hash", *(F.col(c).alias(f"first_{c}") for c in ("title", "author", "language", "description", "series", "series_index"))), "source_hash")


def fn_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("record_id", text.clean_text(F.col("description")).alias("clean"), text.is_meaningful(F.col("description")).alias("meaningful"))


def fn_edition_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("record_id", text.strip_edition_noise(F.col("title")).alias("clean"))


def fn_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("title")
    return _books(spark, sf_dir).select("record_id", text.normalize_text(c).alias("normal"), text.normalize_file_name(c).alias("file_form"), text.slugify(c).alias("slug"), F.array_join(text.useful_words(c), " ").alias("useful"))


def fn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.select("record_id", r(text.word_similarity(F.col("title"), F.col("first_title")), "words"), r(text.title_similarity(F.col("title"), F.col("first_title")), "title_alike"), r(text.author_similarity(F.col("author"), F.col("first_author")), "author_alike"))


def fn_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = _books(spark, sf_dir).select("record_id", "series_index", series.structured_title(F.col("title")).alias("s"))
    return rows.select("record_id", s["title"].alias("title_part"), s["series"].alias("series_part"), s["series_index"].alias("number_part"), series.normalize_series_index(F.col("series_index")).alias("number"), series.same_series_index(F.col("series_index"), s["series_index"]).alias("same"))


def fn_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISBNs of both tables; of a catalogue entry the best one."""
    one = _books(spark, sf_dir).select(F.col("record_id").alias("id"), isbn.normalize_isbn(F.col("isbn")).alias("isbn"))
    return one.unionByName(read_table(spark, sf_dir, "search_documents").select(F.col("search_id").alias("id"), isbn.best_isbn(F.col("isbn")).alias("isbn")))


def fn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir)
    return b.select(
        "record_id", language.is_spanish(F.col("language")).alias("spanish"), language.language_matches(F.lit("es"), F.col("language")).alias("matches"), language.looks_spanish(F.col("description")).alias("looks"),
        language.looks_spanish(F.col("description"), language.CATALOGUE_MARKERS).alias("catalogue_looks"), language.series_looks_spanish(F.col("series")).alias("series_looks"), F.array_join(language.spanish_subjects(F.col("subjects")), "|").alias("subjects"),
    )


def fn_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("record_id", dates.normalize_publication_date(F.col("published"), YEAR).alias("published"), dates.plausible_publication_date(F.col("published"), YEAR).alias("plausible"))


def fn_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    c = filename.canonical_file_name(t, F.col("author"), t, F.col("s"))
    return _books(spark, sf_dir).select("record_id", "title", "author", series.structured_title(t).alias("s")).select("record_id", filename.safe_file_name(t).alias("safe"), filename.device_file_name(t).alias("device"), filename.strip_extension(t).alias("base"), c["file_name"].alias("canonical"), filename.file_kind(F.concat(t, F.lit(".epub")), F.lit(None).cast("string")).alias("kind"))


def fn_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the file names, one row each."""
    b = _books(spark, sf_dir).where("source = 'filename'").select("record_id", "loaded_at", F.posexplode(filename.file_name_hypotheses(F.concat("title", F.lit(".epub")))).alias("at", "h"))
    return b.select("record_id", "loaded_at", "at", "h.kind", "h.origin", "h.confidence", "h.hints.title", "h.hints.author", "h.hints.series", "h.hints.series_index")


def fn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    want = {c: F.col(f"first_{c}") for c in ("title", "author", "language", "series", "series_index")}
    have = {c: F.col(c) for c in ("title", "author", "language", "description", "series", "series_index")}
    t, s = scoring.title_score(want, have), scoring.series_score(want, have)
    return p.select("record_id", t.alias("title_score"), s.alias("series_score"), scoring.weighted(t, F.lit(0.94)).alias("weighted"))


def fn_stats_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "kindle_days").groupBy(text.stats_book_name(F.col("title"), F.col("author")).alias("book_name")).agg(F.count(F.lit(1)).alias("days"))


def fn_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("record_id", F.array_join(text.merge_subjects(F.col("subjects")), "|").alias("subjects"))


def fn_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of each text's bytes, and whether it is small enough to be taken."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("bytes"), (F.octet_length("text") <= 20 * 1024 * 1024).alias("taken"))


_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def _clean(x: str) -> str:
    for pattern, to in ((r"(?i)<br\s*/?>", r"E'\n'"), (r"(?i)</p>", r"E'\n'"), ("<[^>]+>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&quot;", "'\"'"), ("(?i)&#39;", "''''"), ("(?i)&apos;", "''''"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"), (r"[ \t]+", "' '"), (r"[ \t]*\n[ \t]*", r"E'\n'"), (r"\n{3,}", r"E'\n\n'")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return f"nullif({_trim(x)}, '')"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def _useful(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    return f"list_filter(string_split({_normal(x)}, ' '), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w))"


_PAIRS = rf"""
WITH b AS (SELECT DISTINCT ON (record_id) * FROM book_metadata),
lead AS (SELECT * FROM b WHERE record_id IN (SELECT min(record_id) FROM b GROUP BY source_hash)),
p AS (
  SELECT b.record_id, b.title, b.author, b.language, b.description, b.series, b.series_index, lead.title AS ft, lead.author AS fa, lead.language AS fl, lead.series AS fs, lead.series_index AS fi,
    {_normal("b.title")} AS x, {_normal("lead.title")} AS y, {_normal("b.author")} AS ax, {_normal("lead.author")} AS ay, {_normal("b.series")} AS sx, {_normal("lead.series")} AS sy,
    list_distinct({_useful("b.title")}) AS u, list_distinct({_useful("lead.title")}) AS v, list_distinct({_useful("b.author")}) AS au, list_distinct({_useful("lead.author")}) AS av, list_distinct({_useful("b.series")}) AS su, list_distinct({_useful("lead.series")}) AS sv
  FROM b JOIN lead USING (source_hash)
)"""


def _alike(x: str, y: str, u: str, v: str, extra: str = "") -> str:
    jaccard = f"CASE WHEN len({u}) = 0 OR len({v}) = 0 THEN 0.0 ELSE len(list_intersect({u}, {v}))::DOUBLE / len(list_distinct(list_concat({u}, {v}))) END"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0 {extra} ELSE {jaccard} END"


def _title_alike(x: str, y: str, u: str, v: str) -> str:
    return _alike(x, y, u, v, f"WHEN length({x}) >= 8 AND length({y}) >= 8 AND (contains({x}, {y}) OR contains({y}, {x})) THEN 0.92")


_AUTHOR_ALIKE = _alike("ax", "ay", "au", "av", "WHEN contains(ax, ay) OR contains(ay, ax) THEN 0.9 WHEN string_split(ax, ' ')[-1] = string_split(ay, ' ')[-1] THEN 0.78")
_NUMBER = r"CASE WHEN regexp_full_match({t}, '(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN CASE WHEN try_cast({t} AS DOUBLE) = floor(try_cast({t} AS DOUBLE)) THEN floor(try_cast({t} AS DOUBLE))::BIGINT::VARCHAR ELSE try_cast({t} AS DOUBLE)::VARCHAR END END"


def _number(x: str) -> str:
    return _NUMBER.replace("{t}", rf"regexp_replace({_trim(x)}, ',', '.')")


def _bad_values() -> str:
    return ", ".join(f"'{v}'" for v in text.BAD_VALUES)


def _marks(x: str, markers: list[str], least: int) -> str:
    hits = " + ".join(f"contains(' ' || lower({x}) || ' ', ' {m} ')::INT" for m in markers)
    return f"coalesce({x} <> '' AND (regexp_matches({x}, '[áéíóúñ¿¡ÁÉÍÓÚÑ]') OR ({hits}) >= {least}), false)"


_CHECK13 = "list_sum(list_transform(range(13), lambda k: substr(d, k::INT + 1, 1)::INT * (CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END))) % 10 = 0"
_CHECK10 = "list_sum(list_transform(range(10), lambda k: (CASE WHEN substr(d, k::INT + 1, 1) = 'X' THEN 10 ELSE substr(d, k::INT + 1, 1)::INT END) * (10 - k))) % 11 = 0"
_VALID = f"CASE WHEN regexp_full_match(d, '[0-9]{{13}}') THEN {_CHECK13} WHEN regexp_full_match(d, '[0-9]{{9}}[0-9X]') THEN {_CHECK10} ELSE false END"

QUERIES = {
    f.__name__: f
    for f in (fn_clean_text, fn_edition_noise, fn_normal_forms, fn_similarity, fn_series, fn_isbn, fn_language, fn_published, fn_file_names, fn_hypotheses, fn_scores, fn_stats_text, fn_subjects, fn_hashes)
}
_E1 = rf"(?i){_WS}*[(\[]{_WS}*[^)\]]*\b(?:edition|edici[oóOÓ]n)\b[^)\]]*[)\]]{_WS}*\z"
_E2 = rf"(?i){_WS}*[-–—:|]{_WS}*(?:(?:{text.ENGLISH_EDITIONS.replace(chr(39), chr(39) * 2)}){_WS}+)*edition{_WS}*\z"
_E3 = rf"(?i){_WS}+(?:spanish|english|kindle|ebook|e-book|paperback|hardcover|hardback){_WS}+edition{_WS}*\z"
_E4 = rf"(?i){_WS}*[-–—:|]{_WS}*edici[oóOÓ]n(?:{_WS}+(?:{text.SPANISH_EDITIONS}))*{_WS}*\z"
_E5 = rf"(?i){_WS}+edici[oóOÓ]n{_WS}+(?:(?:en{_WS}+)?espa[nñ]ol(?:a)?|kindle|digital){_WS}*\z"


def _edition(x: str) -> str:
    x = _clean(x)
    for _ in range(2):  # a title with three labels doesn't occur
        for e in (_E1, _E2, _E3, _E4, _E5):
            x = f"regexp_replace({x}, '{e}', '', 'g')"
        x = _trim(x)
    return f"nullif({x}, '')"




def _sql_pattern(pattern: str) -> str:
    """A Java pattern of the series forms for RE2, whose case folding is always of Unicode."""
    return pattern.replace("(?isu)", "(?is)").replace("'", "''")


def _series_sql() -> str:
    """CTEs ending in `f`: (record_id, series_index, p), p being the first form's parts that hold."""
    parts = []
    for k, (pattern, title, name, index) in enumerate(series.FORMS):
        e = _sql_pattern(pattern)
        t, n, i = (f"nullif(regexp_extract(t, '{e}', {g}), '')" for g in (title, name, index))
        parts.append(f"SELECT record_id, {k} AS k, {_clean(t)} AS title, {_clean(n)} AS series, {_number(i)} AS idx FROM c WHERE regexp_matches(t, '{e}')")
    return f"""
WITH c AS (SELECT record_id, any_value(title) AS raw, any_value(series_index) AS series_index, any_value(author) AS author, {_clean("any_value(title)")} AS t FROM n GROUP BY record_id),
m AS ({" UNION ALL ".join(parts)}),
f AS (SELECT record_id, arg_min({{'title': title, 'series': series, 'idx': idx}}, k) AS p FROM m WHERE title IS NOT NULL AND series IS NOT NULL AND idx <> '0' GROUP BY record_id)"""


def _sanitized(x: str) -> str:
    for pattern, to in ((r"[\x00-\x1f\x7f]", "''"), (r'[\\/:*?"<>|]', "' - '"), (rf"{_WS}+-{_WS}+-{_WS}+", "' - '"), (rf"{_WS}+", "' '"), (r"[. ]+\z", "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return _trim(x)


_LABEL_EN = rf"(?i){_WS}*[(\[]{_WS}*(?:(?:standard|special|deluxe|collector(?:''s)?|collectors?|international|anniversary|movie{_WS}+tie[- ]?in|illustrated|limited|signed){_WS}+)?edition{_WS}*[)\]]{_WS}*\z"
_LABEL_ES = rf"(?i){_WS}*[(\[]{_WS}*(?:edici[oóOÓ]n{_WS}+(?:est[aá]ndar|especial|de{_WS}+lujo|coleccionista|ilustrada|limitada)){_WS}*[)\]]{_WS}*\z"
_YEAR = r"regexp_extract({c}, '(?:^|[^0-9A-Za-z_])(1\d{3}|20\d{2})(?:$|[^0-9A-Za-z_])', 1)"
ORACLE_SQL = {
    "fn_clean_text": f"SELECT record_id, {_clean('description')} AS clean, {_normal('description')} NOT IN ('', {_bad_values()}) AS meaningful FROM book_metadata",
    "fn_edition_noise": f"SELECT record_id, {_edition('title')} AS clean FROM book_metadata",
    "fn_normal_forms": f"SELECT record_id, {_normal('title')} AS normal, trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '{_WS}+', ' ', 'g')) AS file_form, replace({_normal('title')}, ' ', '-') AS slug, array_to_string({_useful('title')}, ' ') AS useful FROM book_metadata",
    "fn_similarity": _PAIRS + f" SELECT record_id, round({_alike('x', 'y', 'u', 'v')}, 6) AS words, round({_title_alike('x', 'y', 'u', 'v')}, 6) AS title_alike, round({_AUTHOR_ALIKE}, 6) AS author_alike FROM p",
    "fn_isbn": f"""
WITH b AS (SELECT record_id AS id, regexp_replace(upper(isbn), '[^0-9X]', '', 'g') AS d FROM book_metadata),
s AS (SELECT row_number() OVER () AS n, search_id AS id, isbn FROM search_documents),
e AS (SELECT n, id, generate_subscripts(isbn, 1) AS k, regexp_replace(upper(unnest(isbn)), '[^0-9X]', '', 'g') AS d FROM s),
v AS (SELECT n, arg_min(d, (length(d) <> 13, k)) AS d FROM e WHERE {_VALID} GROUP BY n)
SELECT id, CASE WHEN {_VALID} THEN d END AS isbn FROM b UNION ALL SELECT s.id, v.d FROM s LEFT JOIN v USING (n)""",
    "fn_language": f"""
SELECT record_id, coalesce(trim(regexp_replace(lower(language), '^/languages/', '')) IN ('es', 'es-es', 'spa'), false) AS spanish, coalesce(language = '', true) OR lower(substr(language, 1, 2)) = 'es' AS matches,
  {_marks("description", language.MARKERS, 3)} AS looks, {_marks("description", language.CATALOGUE_MARKERS, 3)} AS catalogue_looks, {_marks("series", language.SERIES_MARKERS, 1)} AS series_looks,
  array_to_string(list_filter(subjects, lambda s: regexp_matches(s, '[áéíóúñÁÉÍÓÚÑ]') OR lower(trim(s)) IN ({", ".join(f"'{s}'" for s in language.SUBJECTS)})), '|') AS subjects FROM book_metadata""",
    "fn_published": f"""
WITH c AS (SELECT record_id, {_clean("published")} AS c, {_trim("coalesce(published, '')")} AS t FROM book_metadata),
d AS (SELECT *, CASE WHEN regexp_full_match(c, '\\d{{4}}(-\\d{{2}})?(-\\d{{2}})?') THEN 'strict' END AS kind, strftime(coalesce(try_strptime(c, ['%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y', '%m/%d/%Y', '%Y/%m/%d', '%B %Y', '%b %Y']), CASE WHEN regexp_matches(c, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') THEN try_strptime(c[1:10], '%Y-%m-%d') END), '%Y-%m-%d') AS iso FROM c),
ok AS (SELECT *, coalesce(regexp_full_match(t, '\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?') AND try_cast(t[1:4] AS INT) BETWEEN 1000 AND {YEAR + 2} AND try_cast(CASE length(t) WHEN 4 THEN t || '-01-01' WHEN 7 THEN t || '-01' ELSE t END AS DATE) IS NOT NULL, false) AS plausible FROM d)
SELECT record_id, plausible, CASE WHEN kind = 'strict' THEN CASE WHEN plausible THEN c END WHEN try_cast(iso[1:4] AS INT) BETWEEN 1000 AND {YEAR + 2} THEN iso WHEN try_cast({_YEAR.replace("{c}", "c")} AS INT) BETWEEN 1000 AND {YEAR + 2} THEN {_YEAR.replace("{c}", "c")} END AS published FROM ok""",
    "fn_scores": _PAIRS
    + f""", a AS (SELECT *, {_title_alike('x', 'y', 'u', 'v')} AS t, {_AUTHOR_ALIKE} AS au_, {_title_alike('sx', 'sy', 'su', 'sv')} AS s, {_number("series_index")} AS n, {_number("fi")} AS fn FROM p),
  raw AS (SELECT *, CASE WHEN coalesce(ft, '') = '' OR t <= 0 THEN 0 ELSE floor(greatest(0, least(100, CASE WHEN coalesce(fa, '') <> '' THEN t * 65 + au_ * 30 - CASE WHEN coalesce(author, '') <> '' AND au_ < 0.45 THEN 25 ELSE 0 END ELSE t * 95 END
      + CASE WHEN coalesce(fl, '') <> '' AND coalesce(language, '') <> '' AND lower(substr(fl, 1, 2)) = lower(substr(language, 1, 2)) THEN 3 ELSE 0 END + CASE WHEN coalesce(description, '') <> '' THEN 2 ELSE 0 END)) + 0.5)::INT END AS title_score,
    CASE WHEN s >= 0.55 AND coalesce(n = fn, false) THEN floor(greatest(0, least(100, s * 55 + 30 + CASE WHEN coalesce(fa, '') <> '' THEN au_ * 15 - CASE WHEN coalesce(author, '') <> '' AND au_ < 0.45 THEN 20 ELSE 0 END ELSE 0 END)) + 0.5)::INT ELSE 0 END AS series_score FROM a)
  SELECT record_id, title_score, series_score, floor(greatest(0, least(100, title_score * (0.88 + 0.12 * 0.94::DOUBLE))) + 0.5)::INT AS weighted FROM raw""",
    # One row per record is enough for these: a record that is delivered twice has one title.
    "fn_series": _series_sql().replace("FROM n GROUP BY", "FROM book_metadata GROUP BY", 1)
    + f""" SELECT b.record_id, p.title AS title_part, p.series AS series_part, p.idx AS number_part, {_number("b.series_index")} AS number, coalesce({_number("b.series_index")} = p.idx, false) AS same FROM book_metadata b LEFT JOIN f USING (record_id)""",
    "fn_file_names": _series_sql().replace("FROM n GROUP BY", "FROM book_metadata GROUP BY", 1)
    + f""", parts AS (
      SELECT b.record_id, b.title, CASE WHEN {_normal("b.title")} NOT IN ('', {_bad_values()}) THEN nullif({_sanitized(_trim(f"regexp_replace(regexp_replace(coalesce(p.title, b.title), '{_LABEL_EN}', ''), '{_LABEL_ES}', '')"))}, '') END AS own,
        coalesce(nullif({_sanitized(_trim("regexp_replace(b.title, '(?i)[.]epub$', '')"))}, ''), 'book') AS stand_in, CASE WHEN {_normal("b.author")} NOT IN ('', {_bad_values()}) THEN nullif({_sanitized("b.author")}, '') END AS by_
      FROM book_metadata b LEFT JOIN f USING (record_id)
    ), cut AS (SELECT *, coalesce(own, stand_in) AS name, coalesce(' - ' || by_, '') AS suffix FROM parts),
    done AS (SELECT *, greatest(30, 180 - length(suffix)) AS most, regexp_replace(regexp_replace(regexp_replace(title, '[\\\\/\\x00]', '_', 'g'), '[\\x01-\\x1f\\x7f]', '', 'g'), '{_WS}+', ' ', 'g') AS s FROM cut)
    SELECT record_id, CASE WHEN lower(coalesce(nullif({_trim("s")}, ''), 'book.epub')) LIKE '%.epub' THEN coalesce(nullif({_trim("s")}, ''), 'book.epub') ELSE coalesce(nullif({_trim("s")}, ''), 'book.epub') || '.epub' END AS safe,
      CASE WHEN regexp_replace(title, '[\\\\/\\x00]', '_', 'g') NOT IN ('', '.', '..') THEN regexp_replace(title, '[\\\\/\\x00]', '_', 'g') END AS device,
      {_trim(f"regexp_replace(replace(regexp_replace(title, '(?i)[.](epub|mobi|azw3)$', ''), '_', ' '), '{_WS}+', ' ', 'g')")} AS base,
      CASE WHEN length(name) <= most THEN name ELSE regexp_replace(trim(substr(name, 1, most)), '[. -]+$', '') END || suffix || '.epub' AS canonical, CASE WHEN title IS NOT NULL THEN 'book' ELSE 'other' END AS kind FROM done""",
    "fn_stats_text": "SELECT coalesce(nullif(trim(title), ''), 'Unknown title') || CASE WHEN coalesce(trim(author), '') <> '' THEN ' - ' || trim(author) ELSE '' END || '.epub' AS book_name, count(*) AS days FROM kindle_days GROUP BY 1",
    "fn_subjects": f"""
WITH n AS (SELECT row_number() OVER () AS n, record_id, subjects FROM book_metadata),
e AS (SELECT n, generate_subscripts(subjects, 1) AS k, unnest(subjects) AS s FROM n),
c AS (SELECT n, k, {_clean("s")} AS s FROM e), f AS (SELECT n, {_normal("s")} AS f, arg_min(s, k) AS s, min(k) AS k FROM c WHERE {_normal("s")} <> '' GROUP BY ALL),
l AS (SELECT n, string_agg(s, '|' ORDER BY k) AS subjects FROM f GROUP BY n)
SELECT record_id, l.subjects FROM n LEFT JOIN l USING (n)""",
    "fn_hashes": "SELECT doc_id, sha256(text) AS digest, strlen(text)::INT AS bytes, strlen(text) <= 20971520 AS taken FROM documents",
}
