"""One consistent form of text under which strings that look the same are equal (a confusables skeleton)."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections import defaultdict
from functools import cache, lru_cache

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.sources.shared import checkpointed

# Usual letters of other scripts and the Latin letters they look like, upper and lower case apart. The whole
# public table is added by `look_alike_letters`; where the two differ, these hold.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѡӏЁё"
CYRILLIC_LIKE = "ABESIJKMHOPCTYXaesijopcyxhdqwwlËë"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυϲϳ"
GREEK_LIKE = "ABEZHIKMNOPTYXaikvopucj"
OTHER = "օսԱՕՏⅼⅰⅴⅹⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯıȷɡɑ"
OTHER_LIKE = "ouUOSlivxcdmIVXLCDMijga"
# Kinds of hyphen and of apostrophe that only differ in code point.
HYPHENS = "‐‑⁃﹣−"
# Decompositions that keep the look: width, ligatures and presentation forms, blanks, and styled letters.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}

# Printable ASCII, its blanks and combining marks (but for the invisible joiner U+034F) are their own prototypes.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r -~\u0300-\u034e\u0350-\u036f]+")

Letters = tuple[tuple[int, str], ...]


def _prototype(ch: str) -> str | None:
    """What takes the place of one decomposed character, or None to keep it."""
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    if kind == "Cf" or kind == "Cc" and ch not in "\t\n\r\x0b\x0c" or "︀" <= ch <= "️" or ch in "͏ᅟᅠㅤﾠ឴឵":
        return ""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in SAME_LOOK:
        return unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
    return None


@cache
def prototypes() -> dict[int, str]:
    """Code point -> prototype, for every character that isn't its own: rules over the Unicode database, then the fixed letters."""
    table = {cp: p for cp in range(sys.maxunicode + 1) if (p := _prototype(chr(cp))) is not None and p != chr(cp)}
    for letters, like in ((CYRILLIC, CYRILLIC_LIKE), (GREEK, GREEK_LIKE), (OTHER, OTHER_LIKE)):
        table |= {ord(a): unicodedata.normalize("NFD", b) for a, b in zip(letters, like, strict=True)}
    return table | {ord(h): "-" for h in HYPHENS}


def _case(ch: str) -> str:
    return "upper" if ch.isupper() else "lower" if ch.islower() else ""


def chosen_letters(public: dict[str, str]) -> Letters:
    """(code point, prototype) of the letters that a public table of confusables takes for one other letter.

    The public table ignores case and takes digits and punctuation for letters (I, l and 1 are one); here case stays
    visible: a letter gets the ASCII letter of its own case in its class, or the class's letter if the two are of one case or it has none.
    """
    ascii_letters = defaultdict(list)
    for ch in string.ascii_letters:
        ascii_letters[public.get(ch, ch)].append(ch)
    out = []
    for ch, p in public.items():
        if ch.isascii() or unicodedata.category(ch)[0] != "L" or unicodedata.normalize("NFD", ch) != ch or ord(ch) in prototypes():
            continue
        among = ascii_letters.get(p, [] if "LATIN" in unicodedata.name(ch, "") else [p] if len(p) == 1 and unicodedata.category(p)[0] == "L" else [])
        like = [x for x in among if _case(x) == _case(ch)] or [x for x in among if x == p and not _case(ch)]
        if like and like[0] != ch:
            out.append((ord(ch), unicodedata.normalize("NFD", like[0])))
    return tuple(out)


_of_jvm: dict[int, Letters] = {}


def look_alike_letters(spark: SparkSession) -> Letters:
    """`chosen_letters` of the whole table of Unicode Technical Standard 39, as the ICU library among Spark's own jars has it.

    Its size is that of the standard, whatever the data. Without that library (another Spark, a session without a JVM) it is
    an error: with the fixed letters alone, texts would be missed and nothing would show it.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        raise RuntimeError("the table of look-alike letters is read through the session's JVM, and this session has none")
    if id(jvm) not in _of_jvm:
        letters = [ch for cp in range(sys.maxunicode + 1) if unicodedata.category(ch := chr(cp))[0] == "L"]
        try:
            whole = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters))
        except (Py4JError, TypeError) as e:
            raise RuntimeError("the table of look-alike letters can't be read: the ICU library (com.ibm.icu) among Spark's jars is missing or fails") from e
        _of_jvm[id(jvm)] = chosen_letters(dict(zip(letters, whole.split("\n"), strict=True)))
    return _of_jvm[id(jvm)]


class Skeleton:
    """The skeleton under a table of look-alike letters besides the built-in one."""

    def __init__(self, letters: Letters = ()):
        self.table = dict(letters) | prototypes()

    def _replaced(self, run: re.Match) -> str:
        return run[0].translate(self.table)

    def mapped(self, decomposed: str) -> str:
        """Every character by its prototype. A prototype may itself have one: a full-width letter of another script, a narrow blank."""
        once = UNUSUAL.sub(self._replaced, decomposed)
        return once if once.isascii() else unicodedata.normalize("NFD", UNUSUAL.sub(self._replaced, once))

    def __call__(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() else self.mapped(unicodedata.normalize("NFD", text))


@lru_cache(maxsize=4)
def skeleton_of(letters: Letters) -> Skeleton:
    """The skeleton under these letters, made once a process."""
    return Skeleton(letters)


def skeleton(text: str | None, letters: Letters = ()) -> str | None:
    """Decompose, replace every character by its prototype, decompose again.

    Letter case, accents, punctuation, line breaks and the number of blanks are visible and stay. Null gives null.
    """
    return None if text is None else skeleton_of(letters)(text)


def skeletons(c: Column, letters: Letters = ()) -> Column:
    """`skeleton` of a string column, in Arrow batches."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(skeleton_of(letters), na_action="ignore")

    return of(c)


def consistent_form(texts: DataFrame, text: str = "text", to: str = "consistent") -> DataFrame:
    """`texts` with `to`, its text in a consistent, composed form. Null stays null, empty stays empty."""
    letters = look_alike_letters(texts.sparkSession)

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        form = skeleton_of(letters)
        return s.map(lambda x: unicodedata.normalize("NFC", form(x)), na_action="ignore")

    return texts.withColumn(to, of(F.col(text)))


def _digests(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, variant) of every text, written once."""
    c = F.col(text)
    return checkpointed(texts.where(c.isNotNull()).select(F.col(key), F.sha2(skeletons(c, look_alike_letters(texts.sparkSession)), 256).alias("class_id"), F.sha2(c, 256).alias("variant")))


def _mixed(digests: DataFrame) -> DataFrame:
    """Members of the classes that hold two or more variants."""
    mixed = digests.groupBy("class_id").agg(F.min("variant").alias("__a"), F.max("variant").alias("__z")).where("__a <> __z").select("class_id")
    return digests.join(mixed, "class_id")


def look_alike_classes(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text that has a byte-different text of the same look: (key, class_id STRING, variant STRING, links BIGINT).

    `class_id` names the skeleton, `variant` the exact bytes; both are 256-bit digests, so that only digests are
    shuffled, and the skeletons are made once. `links` counts the texts of the class that aren't byte-identical. Texts
    are grouped by skeleton; a group counts if it holds two or more variants, which is decided by aggregations with
    partial results, so a group that holds most rows isn't gathered anywhere. Null texts belong to no class; empty
    texts look alike only to others that are invisible.
    """
    digests = _digests(texts, key, text)
    variants = digests.groupBy("class_id", "variant").agg(F.count(F.lit(1)).alias("__n"))
    whole = variants.groupBy("class_id").agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__variants")).where("__variants > 1").select("class_id", "__all")
    linked = variants.join(whole, "class_id").select("class_id", "variant", (F.col("__all") - F.col("__n")).alias("links"))
    return digests.join(linked, ["class_id", "variant"]).select(key, "class_id", "variant", "links")


def look_alike_pairs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (key_a, key_b) with key_a < key_b of texts that look the same but aren't byte-identical."""
    members = checkpointed(_mixed(_digests(texts, key, text)))
    a = members.select("class_id", F.col(key).alias(f"{key}_a"), F.col("variant").alias("__a"))
    b = members.select("class_id", F.col(key).alias(f"{key}_b"), F.col("variant").alias("__b"))
    return a.join(b, "class_id").where(f"{key}_a < {key}_b and __a <> __b").select(f"{key}_a", f"{key}_b").distinct()
