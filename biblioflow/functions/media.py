"""Extensions and media types of image files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioflow.functions.text import present

# Extensions in their one form, and their media types.
FORMS = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "webp": "webp"}
TYPES = {"png": "image/png", "webp": "image/webp", "jpg": "image/jpeg"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def image_extension(extension: Column) -> Column:
    """An extension's one form: jpg for any that isn't known, and for null."""
    return F.coalesce(_mapped(F.regexp_replace(F.lower(extension), "[^a-z0-9]", ""), FORMS), F.lit("jpg"))


def extension_of(file_name: Column, path: Column, media_type: Column) -> Column:
    """The extension that a name shows, else a path, else the one of the media type."""
    shown = lambda c: present(F.regexp_extract(c, r"\.([A-Za-z0-9]+)\z", 1))
    seen = F.coalesce(shown(file_name), shown(path))
    by_type = F.coalesce(_mapped(F.lower(media_type), {t: e for e, t in TYPES.items()}), F.lit("jpg"))
    return F.when(seen.isNotNull(), image_extension(seen)).otherwise(by_type)


def media_type_of(extension: Column) -> Column:
    """The media type of an extension; that of jpg for any that isn't known, and for null."""
    return F.coalesce(_mapped(extension, TYPES), F.lit(TYPES["jpg"]))
