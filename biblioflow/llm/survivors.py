"""One surviving record for each group of duplicates, chosen field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands in place of a description, and words of shop notices.
NO_DESCRIPTION = ["", ".", "-", "n/a", "null", "none", "sin descripción", "sinopsis pendiente", "no description available.", "no description available", "descripción no disponible por el momento.", "lorem ipsum dolor sit amet."]
NOTICE = r"(?iu)\b(epub|mobi|descuento|discount|tarjeta|transferencia|bank transfer|envíos|dispatched|tienda|our (?:store|shop)|devolución|returns policy|dispositivos de lectura|reading devices)\b"
CUT_END = r"(?u)(\(más\)|\(more\)|\[\.{3}\]|\[…\]|leer más|read more|…|\.{3})\s*$"
WHOLE_END = r"[.!?][\"'»”’)\]]*$"
GARBLED = "[ÂÃâ][\u0080-¿ŒœŠšŸŽž–-•…€™]|�"
# Names that are no publishing house, words of tools, and dotted words that a full name may have.
NO_HOUSE = ["", "-", "n/a", "null", "none", "unknown", "desconocido", "desconocida", "sin editorial", "no publisher"]
TOOL = r"(?iu)\d|convert|convers|generad|generated|build|maker|packer|epub"
DOTTED = r"(?iu)^(?:st|dr|mr|mrs|co|inc|ltd|s\.a|s\.l)\.$"
BARE = r"^(?:\S*\. )*(\p{Lu}\p{L}{2,})$"  # "X", "Ed. X", "G. E. X": the short form of a house
# Shelves of readers, which aren't subjects.
SHELVES = ["my-books", "owned-books", "library", "kindle", "audiobook", "audiobooks", "favorites", "favourites", "currently-reading", "wish-list", "wishlist", "to-read", "owned", "ebooks", "ebook", "e-book", "books", "default"]
SHELF = r"^read-in-\d{4}$|^\d+$"


@dataclass(frozen=True)
class Field:
    """A field to fill: which values are usable, and how good one is (more is better; null means unusable)."""

    name: str
    quality: Column


def plain_text(c: Column) -> Column:
    """`c` without tags and entities, blanks made one."""
    c = F.regexp_replace(c, r"(?s)</?[A-Za-z][^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def description_quality(c: Column) -> Column:
    """Length of the whole text about a book; null for placeholders, shop notices, cut-off and garbled text."""
    text = plain_text(c)
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    notices = F.size(F.filter(parts, lambda s: s.rlike(NOTICE)))
    bad = F.lower(text).isin(NO_DESCRIPTION) | text.rlike(CUT_END) | ~text.rlike(WHOLE_END) | c.rlike(GARBLED) | (2 * notices > F.size(parts))
    return F.when(~bad, F.length(text).cast("double"))


def publisher_name(c: Column) -> Column:
    """A publisher's name that isn't seen to be short by itself; null for placeholders, tools, dotted abbreviations and marks of a cut."""
    name = F.regexp_replace(F.trim(c), r"\s+", " ")
    dotted = F.exists(F.split(name, " "), lambda t: t.endswith(".") & ~t.rlike(DOTTED))
    return F.when(~(F.lower(name).isin(NO_HOUSE) | name.rlike(TOOL) | dotted | name.rlike(CUT_END)) & name.rlike(r"\p{L}{2}"), name)


def publisher_quality(c: Column) -> Column:
    """Length of a publishing house's name, null for none. Whether it is a short form, other names tell (`short_names`)."""
    return F.length(publisher_name(c)).cast("double")


def page_count_quality(c: Column) -> Column:
    """1 for a possible number of pages (whole, 20 to 5,000), else null: every possible one is as good, and the latest holds."""
    return F.when(~F.isnan(c) & (c >= 20) & (c <= 5000) & (c == F.floor(c)), F.lit(1.0))


def subjects_quality(c: Column) -> Column:
    """How many different genuine subjects a list names, null for none; a string of several subjects counts as these."""
    names = F.flatten(F.transform(c, lambda s: F.split(F.coalesce(s, F.lit("")), r"\s*(?:;|,| / | -- )\s*")))
    names = F.filter(F.transform(names, lambda s: F.lower(F.trim(s))), lambda s: (F.length(s) > 0) & ~s.isin(SHELVES) & ~s.rlike(SHELF))
    n = F.size(F.array_distinct(names))
    return F.when(n > 0, n.cast("double"))


def precedence(rows: DataFrame, group: str, state: str, time: str) -> DataFrame:
    """(state, rank): how each value of `state` follows the others within groups, learned from the rows with a time.

    A value precedes another in a group if its last time there is before the other's first. The value that more
    groups put later than another wins against it; values are ranked by their share of the others they win against,
    which is a topological order wherever there is one, and breaks cycles where there isn't. Groups are reduced to
    the first and last time of each value before any are compared, and the counts stay distributed.
    """
    spans = rows.where(F.col(time).isNotNull() & F.col(state).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(state).alias("s")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    a, b = spans.select("g", F.col("s").alias("a"), "hi"), spans.select("g", F.col("s").alias("b"), "lo")
    pairs = a.join(b, "g").where("hi < lo").groupBy("a", "b").count()
    wins = pairs.select("a", "b", F.col("count").alias("n")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("count")).alias("n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return wins.groupBy(F.col("b").alias("state")).agg(F.avg((F.col("n") > 0).cast("double")).alias("rank"))


def surviving_values(rows: DataFrame, group: str, record: str, fields: list[Field], state: str, time: str) -> DataFrame:
    """(group, field, record): for each group of two or more records and each field with a usable value, the record
    whose value survives.

    The best value by the field's quality survives; among equals the most current: the latest by `time`, where a
    record without a time follows those whose `state` its own is learned to follow (`precedence`), so the group's
    partial order gives one topologically latest record. Ties go to the smaller record id. One aggregation with
    map-side partial results over all fields, in which no text is moved, so a hot group is no hot task. Rows without
    a group or record are left out; repeated rows count once; a field without usable value gives no row.
    """
    known = rows.where(F.col(group).isNotNull() & F.col(record).isNotNull()).select(
        F.col(group).alias("__g"), F.col(record).alias("__r"), F.col(time).alias("__t"), F.col(state).alias("__s"), F.lit(-1.0).alias("__k"), *(f.quality.alias(f"__q{i}") for i, f in enumerate(fields))
    )
    if not known.where("__t is null").isEmpty():  # without such records times decide alone
        ranks = precedence(rows, group, state, time).select(F.col("state").alias("__s"), "rank")
        known = known.join(ranks, "__s", "left").withColumn("__k", F.coalesce("rank", F.lit(-1.0)))
    best = []
    for i in range(len(fields)):
        q = F.col(f"__q{i}")
        value = F.struct(q.alias("q"), F.col("__r").alias("r"), F.col("__k").alias("k"))
        dated = F.when(q.isNotNull() & F.col("__t").isNotNull(), F.struct(q, "__t", -F.col("__r")))
        undated = F.when(q.isNotNull() & F.col("__t").isNull(), F.struct(q, "__k", -F.col("__r")))
        best += [F.max_by(value, dated).alias(f"__d{i}"), F.max_by(value, undated).alias(f"__u{i}")]
    groups = known.groupBy("__g").agg(F.min("__r").alias("__a"), F.max("__r").alias("__z"), *best).where("__a <> __z")
    chosen = []
    for i, f in enumerate(fields):
        d, u = F.col(f"__d{i}"), F.col(f"__u{i}")
        later = d.isNull() | (u["q"] > d["q"]) | ((u["q"] == d["q"]) & (u["k"] > d["k"]))
        chosen.append(F.struct(F.lit(f.name).alias("field"), F.when(u.isNotNull() & later, u["r"]).otherwise(d["r"]).alias("record")))
    out = groups.select(F.col("__g").alias(group), F.explode(F.array(*chosen)).alias("__x"))
    return out.select(group, "__x.field", F.col("__x.record").alias(record)).where(F.col(record).isNotNull())


def short_names(names: DataFrame, name: str) -> DataFrame:
    """Distinct names of houses (`publisher_name`) that other names show to be short forms:

    one word that stands in a longer name; a longer name without a run of its inner words; and the beginning of a name
    at least as frequent, cut off without a mark, unless its own last word is a short form in use ("Ed. X", "X").
    Every name is compared through its own parts, so the work grows with the number of different names.
    """
    each = names.groupBy(F.trim(F.col(name)).alias("__raw")).count()
    counts = each.select(publisher_name(F.col("__raw")).alias("__n"), "count").where("__n is not null").groupBy("__n").agg(F.sum("count").alias("count"))
    longer = counts.select("__n", "count", F.split("__n", " ").alias("__t")).where("size(__t) > 1")
    words = longer.select(F.explode("__t").alias("__n"))
    # A run of inner words from place i on, j of them, left out.
    inner = F.expr("flatten(transform(sequence(2, size(__t) - 1), i -> transform(sequence(1, size(__t) - i), j -> concat_ws(' ', slice(__t, 1, i - 1), slice(__t, i + j, size(__t))))))")
    without = longer.where("size(__t) > 2").select(F.explode(inner).alias("__n"))
    least = F.length(F.element_at("__t", 1)) + 2
    begun = longer.where(F.length("__n") > least).select(F.col("count").alias("__more"), F.explode(F.transform(F.sequence(least, F.length("__n") - 1), lambda k: F.rtrim(F.substring(F.col("__n"), F.lit(1), k)))).alias("__n"))
    cut = begun.groupBy("__n").agg(F.max("__more").alias("__more")).join(counts, "__n").where("__more >= count").select("__n", F.element_at(F.split("__n", " "), -1).alias("__stem"))
    stems = each.select(F.regexp_extract("__raw", BARE, 1).alias("__stem")).where("__stem <> ''").distinct()
    cut = cut.join(stems, "__stem", "left_anti").select("__n")
    return words.unionByName(without).unionByName(cut).distinct().join(counts, "__n", "left_semi").select(F.col("__n").alias(name))
