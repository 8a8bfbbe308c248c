"""Comparable words of a text: what remains when case, accents, punctuation, markup and look-alike letters don't count."""

from __future__ import annotations

import html
import re
import unicodedata

from biblioflow.llm.visible import Letters, skeleton_of

TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.DOTALL)
MARK = re.compile(r"[̀-ͯ]+")
WORD = re.compile(r"[^\W_]+")
# How the bytes of UTF-8 show when they were read as Windows-1252.
TAIL = r"[\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]"
MOJIBAKE = re.compile(f"[\u00c2-\u00c5]{TAIL}|\u00e2{TAIL}{TAIL}")


def _byte(ch: str) -> int:
    try:
        return ch.encode("cp1252")[0]
    except UnicodeEncodeError:
        return ord(ch)


def _mend(found: re.Match) -> str:
    try:
        return bytes(map(_byte, found[0])).decode("utf-8")
    except (UnicodeDecodeError, ValueError):
        return found[0]


def mended(text: str) -> str:
    """`text` with UTF-8 that was read as Windows-1252 put right, wherever it occurs."""
    return MOJIBAKE.sub(_mend, text)


def plain(text: str) -> str:
    """`text` without markup: tags become blanks, entities their characters."""
    text = TAG.sub(" ", text) if "<" in text else text
    return html.unescape(text) if "&" in text else text


def folded(text: str, letters: Letters = ()) -> str:
    """Skeleton of the plain text in lower case without accents."""
    text = plain(text)
    if not text.isascii():
        # Marks go first: most of what isn't ASCII is a letter and its accent.
        text = MARK.sub("", unicodedata.normalize("NFD", text))
    text = skeleton_of(letters)(text).lower()
    return text if text.isascii() else MARK.sub("", unicodedata.normalize("NFD", text))


def words(text: str | None, letters: Letters = ()) -> list[str]:
    """The comparable words of a text in order; none for null or empty text."""
    return WORD.findall(folded(text, letters)) if text else []
