"""Metadata in XML package documents and HTML pages, by pattern."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from biblioflow.functions.dates import normalize_publication_date
from biblioflow.functions.isbn import normalize_isbn
from biblioflow.functions.text import ENTITIES, bind, clean_text, present, trim_all

# Named letters that pages use besides the common entities.
LETTERS = [("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&uuml;", "ü"), ("&ntilde;", "ñ")]
# The beginning of a page that asks whether the visitor is a person.
CHALLENGE_CHARS = 12_000
CHALLENGE = r"just a moment|cf-challenge|challenge-platform|attention required|enable javascript and cookies"


def decode_xml(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", char)
    return c


def strip_xml(c: Column) -> Column:
    """Plain text of an element's content, null if it is empty."""
    return clean_text(decode_xml(F.regexp_replace(c, r"<[^>]+>", " ")))


def _element(name: str) -> str:
    return rf"(?is)<(?:[\w.-]+:)?{name}\b[^>]*>(.*?)</(?:[\w.-]+:)?{name}>"


def element(xml: Column, name: str) -> Column:
    """Text of the first element of a local name, whatever its prefix; null if there is none or it is empty."""
    return strip_xml(present(F.regexp_extract(xml, _element(name), 1)))


def elements(xml: Column, name: str) -> Column:
    """Texts of all elements of a local name that aren't empty, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(xml, F.lit(_element(name)), F.lit(1)), strip_xml))


def named_meta(xml: Column, name: str) -> Column:
    """Content of the first <meta> of a name, whatever the order of its attributes; null without content."""
    tag = rf"""(?i)<meta\b(?=[^>]*\bname=["']{re.escape(name)}["'])[^>]*\bcontent=["']([^"']*)["'][^>]*>"""
    return trim_all(decode_xml(present(F.regexp_extract(xml, tag, 1))))


def property_meta(xml: Column, name: str) -> Column:
    """Text of the first <meta> of a property."""
    return strip_xml(present(F.regexp_extract(xml, rf"""(?is)<meta\b(?=[^>]*\bproperty=["']{re.escape(name)}["'])[^>]*>(.*?)</meta>""", 1)))


def package_path(container: Column) -> Column:
    """Where a container document says the package document is."""
    return present(F.regexp_extract(container, r"""(?i)<rootfile\b[^>]*\bfull-path=["']([^"']+)["'][^>]*>""", 1))


def package_metadata(opf: Column, year: int) -> Column:
    """Metadata of a package document as a struct of the twelve fields; absent ones are null, subjects a list."""
    series, index = named_meta(opf, "calibre:series"), named_meta(opf, "calibre:series_index")
    pages = named_meta(opf, "page_count").try_cast("double")
    isbns = F.array_compact(F.transform(elements(opf, "identifier"), normalize_isbn))
    return F.struct(
        element(opf, "title").alias("title"), element(opf, "creator").alias("author"), element(opf, "description").alias("description"), element(opf, "language").alias("language"),
        F.try_element_at(isbns, F.lit(1)).alias("isbn"), element(opf, "publisher").alias("publisher"), normalize_publication_date(element(opf, "date"), year).alias("published"),
        F.when((pages > 0) & (pages < float("inf")), pages).alias("page_count"),
        F.when(series.isNotNull(), clean_text(series)).otherwise(property_meta(opf, "belongs-to-collection")).alias("series"),
        F.when(series.isNotNull(), clean_text(index)).otherwise(property_meta(opf, "group-position")).alias("series_index"), elements(opf, "subject").alias("subjects"),
    )


@F.pandas_udf(StringType())
def numeric_entities(s: pd.Series) -> pd.Series:
    """Numeric character references replaced by their characters; those of no character stay."""

    def of(m: re.Match) -> str:
        code = int(m[1], 10) if m[1] else int(m[2], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return s.str.replace(r"&#(?:(\d{1,9})|[xX]([0-9a-fA-F]{1,8}));", of, regex=True)


def decode_html(c: Column) -> Column:
    """Common entities, accented letters and numeric references decoded once each."""
    for entity, char in (*ENTITIES, *LETTERS):
        c = F.regexp_replace(c, f"(?i){entity}", char)
    return F.when(F.contains(c, F.lit("&#")), numeric_entities(c)).otherwise(c)


def _bare(c: Column, breaks: bool) -> Column:
    if breaks:
        c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")
    return F.regexp_replace(c, r"<[^>]+>", "")


def html_text(c: Column, breaks: bool = False) -> Column:
    """Text of a page's fragment without scripts and styles, tags leaving nothing behind; line breaks kept if asked for."""
    c = decode_html(_bare(c, breaks))
    if breaks:
        c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    else:
        c = F.regexp_replace(c, r"(?U)\s+", " ")
    return present(trim_all(c))


def block(html: Column, ident: str) -> Column:
    """Content of the division of an id, up to the first end of a division."""
    return present(F.regexp_extract(html, rf"""(?is)<div\b[^>]*id=["']{re.escape(ident)}["'][^>]*>(.*?)</div>""", 1))


def first_tag(html: Column, tag: str) -> Column:
    return present(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def page_metadata(html: Column) -> Column:
    """Metadata of a catalogue page with the blocks title, autor, serie, genero and sinopsis."""
    serie = block(html, "serie")
    label = html_text(present(F.regexp_extract(serie, r"""(?is)<span\b[^>]*class=["'][^"']*tagTitle[^"']*["'][^>]*>(.*?)</span>""", 1)))
    number = F.replace(present(F.regexp_extract(label, r"(?i)Libro\s+(\d+(?:[.,]\d+)?)\s+de:", 1)), F.lit(","), F.lit("."))
    anchors = F.regexp_extract_all(block(html, "genero"), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    subjects = F.array_distinct(F.array_compact(F.transform(anchors, lambda a: present(trim_all(F.regexp_replace(_named(_bare(a, False)), r"(?U)\s+", " "))))))
    return F.struct(
        html_text(first_tag(block(html, "title"), "h1")).alias("title"), html_text(first_tag(block(html, "autor"), "a")).alias("author"), html_text(first_tag(serie, "a")).alias("series"), number.alias("series_index"),
        html_text(block(html, "sinopsis"), True).alias("description"), F.when(F.size(subjects) > 0, subjects).alias("subjects"),
    )


def _named(c: Column) -> Column:
    for entity, char in (*ENTITIES, *LETTERS):
        c = F.regexp_replace(c, f"(?i){entity}", char)
    return c


def is_challenge(html: Column) -> Column:
    """Whether a page only asks for a sign of a person; only its beginning is looked at."""
    return F.lower(F.substring(html, 1, CHALLENGE_CHARS)).rlike(CHALLENGE)


def links(html: Column, pattern: str, most: int = 2) -> Column:
    """The first different addresses of a page that match."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)\bhref=["']([^"'#]+)["']"""), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda u: u.rlike(pattern))), 1, most)


def last_event(body: Column) -> Column:
    """The last finished event (status done or error) of an event stream, as JSON text; lines that aren't JSON are skipped."""
    lines = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: trim_all(F.substring(x, F.lit(6), F.length(x))))
    ended = F.filter(lines, lambda x: F.get_json_object(x, "$.status").isin("done", "error"))
    return bind(ended, lambda e: F.try_element_at(e, F.size(e)))


def rewrite_package(opf: str, fields: dict[str, str | None], subjects: list[str] | None = None) -> str:
    """A package document with elements set to `fields` (in place, or added to its metadata) and its subjects replaced.

    Raises ValueError if it has no metadata section and something has to be added.
    """

    def add(xml: str, fragment: str) -> str:
        end = re.search(r"(?i)</(?:[\w.-]+:)?metadata\s*>", xml)
        if not end:
            raise ValueError("the package document has no metadata section")
        return f"{xml[: end.start()]}  {fragment}\n{xml[end.start() :]}"

    for name, value in fields.items():
        if not value:
            continue
        text = entities.escape(value, quote=True)
        found = re.search(rf"(?is)<((?:[\w.-]+:)?{name})\b([^>]*)>.*?</\1>", opf)
        opf = opf[: found.start()] + f"<{found[1]}{found[2]}>{text}</{found[1]}>" + opf[found.end() :] if found else add(opf, f"<dc:{name}>{text}</dc:{name}>")
    seen: dict[str, str] = {}
    for s in subjects or []:
        if s and s.strip():
            seen.setdefault(s.strip().lower(), s.strip())
    if seen:
        opf = re.sub(r"(?is)<(?:[\w.-]+:)?subject\b[^>]*>.*?</(?:[\w.-]+:)?subject\s*>", "", opf)
        for s in seen.values():
            opf = add(opf, f"<dc:subject>{entities.escape(s, quote=True)}</dc:subject>")
    return opf
