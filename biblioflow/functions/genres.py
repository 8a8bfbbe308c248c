"""Readers' labels as subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioflow.functions.text import bind, clean_text, trim_all

# Shelves that aren't genres (compared after dashes became blanks, so those with dashes never match).
SHELVES = ["audio", "audiobook", "audiobooks", "ebook", "ebooks", "e-book", "kindle", "owned", "owned-books", "to-read", "currently-reading", "favorites", "favourites"]
# Labels that stay English, written with capitals.
TROPES = [
    "age gap", "best friends to lovers", "brother's best friend", "childhood friends to lovers", "enemies to lovers", "fake dating", "forbidden romance", "forced proximity", "friends to lovers",
    "friends with benefits", "found family", "grumpy sunshine", "love triangle", "marriage of convenience", "one bed", "reverse harem", "rivals to lovers", "second chance", "second chance romance",
    "slow burn", "small town romance", "workplace romance",
]
# English genres and their Spanish names.
GENRES = {
    "adult": "Adulto", "adventure": "Aventuras", "contemporary": "Contemporánea", "crime": "Crimen", "dark fantasy": "Fantasía oscura", "dragons": "Dragones", "dystopia": "Distopía", "epic fantasy": "Fantasía épica",
    "fantasy": "Fantasía", "fantasy romance": "Romance fantástico", "fiction": "Ficción", "historical": "Histórica", "historical fiction": "Ficción histórica", "high fantasy": "Alta fantasía", "horror": "Terror", "lgbt": "LGBT",
    "lgbtq": "LGBTQ+", "magic": "Magia", "mystery": "Misterio", "mythology": "Mitología", "new adult": "New Adult", "paranormal": "Paranormal", "romance": "Romance", "romantasy": "Romantasy",
    "science fiction": "Ciencia ficción", "thriller": "Thriller", "urban fantasy": "Fantasía urbana", "vampires": "Vampiros", "witches": "Brujas", "young adult": "Juvenil",
}


def translate_genre(c: Column) -> Column:
    """A reader's label as a subject: null for shelves, tropes with capitals, known genres in Spanish, others as they are."""
    names = {t: " ".join(w.capitalize() for w in t.split(" ")) for t in TROPES} | GENRES
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def of(clean: Column) -> Column:
        plain = trim_all(F.regexp_replace(F.regexp_replace(F.lower(clean), "[_-]+", " "), r"\s+", " "))
        return bind(plain, lambda n: F.when(~n.isin(SHELVES), F.coalesce(known[n], clean)))

    return bind(clean_text(c), of)
