"""Cleaning, normal forms and similarity of short texts, all on the JVM side.

Null in gives null out unless a docstring says otherwise; empty text counts as absent where a function says so.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal forms of values that say nothing.
BAD_VALUES = ["unknown", "unknown author", "unknown title", "untitled", "no title", "no author", "desconocido", "desconocida", "autor desconocido", "autora desconocida", "sin autor", "sin autora", "sin titulo", "none", "null", "n a"]
# Words that don't count in a comparison.
STOP_WORDS = ["el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "al", "y", "e", "en", "the", "a", "an", "of", "and", "in"]
# Entities and what they stand for, in the order in which they are replaced.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")]
# Binding and edition words that may precede "edition" at the end of a title.
ENGLISH_EDITIONS = r"spanish|english|kindle|ebook|e-book|paperback|hardcover|hardback|standard|special|deluxe|collector(?:'s)?|collectors?|international|anniversary|movie\s+tie[- ]?in|illustrated|limited|signed|first|second|revised|updated"
SPANISH_EDITIONS = r"(?:en\s+)?(?:espa[nñ]ol(?:a)?|ingl[eé]s)|est[aá]ndar|especial|de\s+lujo|coleccionista|internacional|aniversario|ilustrada|limitada|firmada|revisada|actualizada|kindle|digital"

SPACE = r"[\s\x0b\u0085   -     　﻿]"  # of the pattern \s, as other engines have it


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use(c)`, with `c` evaluated once however often `use` mentions it; keeps plans of nested expressions small."""
    return F.element_at(F.transform(F.array(c), use), 1)


def trim_all(c: Column) -> Column:
    """`c` without blanks of any kind at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def present(c: Column) -> Column:
    """`c`, or null if it is empty."""
    return F.nullif(c, F.lit(""))


@cache
def accent_table() -> tuple[str, str]:
    """Letters whose decomposition is an ASCII letter or digit with marks, and those letters; then the marks, for removal."""
    pairs = []
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalnum() and all("̀" <= m <= "ͯ" for m in parts[1:]):
            pairs.append((ch, parts[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """`c` with Latin letters bare of their accents, composed or split off."""
    return F.translate(c, *accent_table())


def clean_text(c: Column) -> Column:
    """`c` as plain text: line breaks for <br> and </p>, blanks for other tags, entities decoded once each in a fixed
    order (so "&amp;lt;" becomes "<"), blanks collapsed, at most one empty line. Empty text gives null."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</p>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", char)
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return present(trim_all(c))


def strip_edition_noise(c: Column) -> Column:
    """A title without its trailing edition labels, taken off in up to three passes; null if nothing is left."""
    patterns = [
        rf"(?iu)\s*[(\[]\s*[^)\]]*\b(?:edition|edici[oó]n)\b[^)\]]*[)\]]\s*\z",
        rf"(?iu)\s*[-–—:|]\s*(?:(?:{ENGLISH_EDITIONS})\s+)*edition\s*\z",
        r"(?iu)\s+(?:spanish|english|kindle|ebook|e-book|paperback|hardcover|hardback)\s+edition\s*\z",
        rf"(?iu)\s*[-–—:|]\s*edici[oó]n(?:\s+(?:{SPANISH_EDITIONS}))*\s*\z",
        r"(?iu)\s+edici[oó]n\s+(?:(?:en\s+)?espa[nñ]ol(?:a)?|kindle|digital)\s*\z",
    ]
    c = clean_text(c)
    for _ in range(3):
        for p in patterns:
            c = F.regexp_replace(c, p, "")
        c = trim_all(c)
    return clean_text(c)


def normalize_text(c: Column) -> Column:
    """Lower case without accents, every run of other characters one blank; '' for null."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def normalize_file_name(c: Column) -> Column:
    """Lower case without accents and with single blanks, punctuation kept; '' for null."""
    return trim_all(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), rf"{SPACE}+", " "))


def slugify(c: Column) -> Column:
    """`normalize_text` with dashes for blanks."""
    return F.replace(normalize_text(c), F.lit(" "), F.lit("-"))


def is_meaningful(c: Column) -> Column:
    """Whether a value says something: not null, not empty, and not a word for "unknown"."""
    n = normalize_text(c)
    return (n != "") & ~n.isin(BAD_VALUES)


def _useful(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def useful_words(c: Column) -> Column:
    """The words of the normal form with two letters or more that aren't stop words, in order."""
    return _useful(normalize_text(c))


def _similarity(a: Column, b: Column, near: Callable[[Column, Column], list[tuple[Column, float]]]) -> Column:
    """Of two normal forms: 0 if one is empty, 1 if both are equal, the first value of `near` that applies, else the shared part
    of the useful words (0 if one has none)."""

    def shared(p: Column) -> Column:
        u, v = p["u"], p["v"]
        return F.when((F.size(u) == 0) | (F.size(v) == 0), 0.0).otherwise(F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v)))

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        out = F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0)
        for applies, value in near(x, y):
            out = out.when(applies, value)
        words = F.struct(F.array_distinct(_useful(x)).alias("u"), F.array_distinct(_useful(y)).alias("v"))
        return out.otherwise(bind(words, shared))

    return bind(F.struct(a.alias("x"), b.alias("y")), of)


def word_similarity(a: Column, b: Column) -> Column:
    """Shared part of the useful words: 1 for equal normal forms, 0 if one is empty or has no useful word."""
    return _similarity(normalize_text(a), normalize_text(b), lambda x, y: [])


def title_similarity(a: Column, b: Column) -> Column:
    """As `word_similarity`, and 0.92 if one of two titles of eight letters or more contains the other."""
    return normal_title_similarity(normalize_text(a), normalize_text(b))


def normal_title_similarity(a: Column, b: Column) -> Column:
    """`title_similarity` of normal forms."""
    return _similarity(a, b, lambda x, y: [((F.length(x) >= 8) & (F.length(y) >= 8) & (F.contains(x, y) | F.contains(y, x)), 0.92)])


def author_similarity(a: Column, b: Column) -> Column:
    """As `word_similarity`, and 0.9 if one contains the other, 0.78 if their last words are equal."""
    return normal_author_similarity(normalize_text(a), normalize_text(b))


def normal_author_similarity(a: Column, b: Column) -> Column:
    """`author_similarity` of normal forms."""
    last = lambda x: F.element_at(F.split(x, " "), -1)
    return _similarity(a, b, lambda x, y: [(F.contains(x, y) | F.contains(y, x), 0.9), (last(x) == last(y), 0.78)])


def clean_stats_text(c: Column, fallback: str) -> Column:
    """`c` without NUL characters and surrounding blanks; `fallback` for null and for what is then empty."""
    ascii_blank = r"[ \t\n\x0b\f\r]"
    c = F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), rf"\A{ascii_blank}+|{ascii_blank}+\z", "")
    return F.coalesce(present(c), F.lit(fallback))


def stats_book_name(title: Column, author: Column) -> Column:
    """"title - author.epub", or "title.epub" without an author."""
    a = clean_stats_text(author, "")
    return F.concat(clean_stats_text(title, "Unknown title"), F.when(a != "", F.concat(F.lit(" - "), a)).otherwise(""), F.lit(".epub"))


def merge_subjects(*lists: Column) -> Column:
    """Cleaned subjects of all lists in order, the first of each normal form; null if there is none."""
    every = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    pairs = F.filter(F.transform(F.transform(every, clean_text), lambda s: F.struct(s.alias("s"), normalize_text(s).alias("n"))), lambda p: p["n"] != "")
    firsts = F.aggregate(
        pairs,
        F.array().cast("array<struct<s:string,n:string>>"),
        lambda seen, p: F.when(F.exists(seen, lambda q: q["n"] == p["n"]), seen).otherwise(F.concat(seen, F.array(p))),
    )
    return F.when(F.size(firsts) > 0, F.transform(firsts, lambda p: p["s"]))
