"""Spellings of names that mean the same person or organisation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.llm.components import components
from biblioflow.llm.names import Lexicon, Name, agreement, is_weak, lexicon, readings, scanned, slots
from biblioflow.sources.shared import checkpointed

SUFFIX = 4  # letters of a token suffix (or beginning) that two spellings must share: an error in the middle of nine leaves four
COMMON = 400  # spellings from which on a suffix is too common and what it leaves of the surname must agree but for errors
LEFT_OUT = 0.305  # share of a surname's letters that one of ratio 0.82 may lack
LONG = 17  # letters from which on surnames of a common suffix meet whatever the rest is: leaving out more than four is too many keys
SECOND_SHARE, SECOND_LEAST = 0.001, 4  # of all names, and of different surnames, that a usual second surname goes with
GIVEN_SHARE, GIVEN_LEAST, GIVEN_ODDS = 0.0001, 4, 3  # of all names, and of different surnames, that a given name goes with, and how much oftener than it is one
PARTS = "surname string, given string, middle string, second string, organisation boolean, weak boolean"


def parsed_names(names: DataFrame, name: str, lex: Lexicon | None = None) -> DataFrame:
    """(name, reading, surname, given, middle, second, organisation, weak): the parts of each name that means somebody.

    `reading` 0 is the likeliest; a name of which nothing tells the given names from the surnames has another one.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(x, k, *p, is_weak(p, lex)) for x in batch["name"] for k, p in enumerate(readings(x, lex))]
            yield pd.DataFrame(rows, columns=["name", "reading", "surname", "given", "middle", "second", "organisation", "weak"])

    return names.select(F.col(name).alias("name")).mapInPandas(parts, f"name string, reading int, {PARTS}")


def given_names(names: DataFrame, name: str, total: int) -> frozenset[str]:
    """Tokens that stand where given names do ("Surname, Given", "Given ... Surname") beside many different surnames, and
    seldom where surnames do: at most a few for each 1 / GIVEN_SHARE of the names. Typing errors and short forms of a commoner one are none.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for n in batch["name"] for x in slots(n)], columns=["token", "slot", "partner"])

    seen = names.select(F.col(name).alias("name")).mapInPandas(ends, "token string, slot string, partner string").distinct()
    counts = seen.groupBy("token").agg(F.sum((F.col("slot") == "g").cast("int")).alias("g"), F.sum((F.col("slot") == "s").cast("int")).alias("s"))
    usual = counts.where((F.col("g") >= max(GIVEN_LEAST, GIVEN_SHARE * total)) & (F.col("g") >= GIVEN_ODDS * F.col("s")))
    kept: set[str] = set()
    lex = Lexicon()
    for r in usual.orderBy(F.desc("g"), "token").collect():
        # Commoner ones come first.
        short = len(r.token) <= 4 and any(n.startswith(r.token) for n in kept)
        if not short and lex.known(r.token) is None:
            kept.add(r.token)
            lex.add(r.token)
    return frozenset(kept)


def second_surnames(parsed: DataFrame, total: int) -> frozenset[str]:
    """Tokens that follow many different surnames and seldom are one: at most 1 / SECOND_SHARE of them."""
    people = parsed.where("not organisation and reading = 0")
    after = people.where("length(second) > 2").groupBy("second").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring("surname", 1, 4)).alias("partners"))
    usual = after.where((F.col("partners") >= max(SECOND_LEAST, SECOND_SHARE * total)))
    first = people.where("second <> ''").groupBy(F.col("surname").alias("second")).agg(F.count(F.lit(1)).alias("own"))
    return frozenset(r.second for r in usual.join(first, "second", "left").where("n >= 4 * coalesce(own, 0)").select("second").collect())


def learned(names: DataFrame, name: str) -> Lexicon:
    """The lexicon of a column of distinct names, counted over all of them."""
    total = names.count()
    given = given_names(names, name, total)
    return lexicon(given, second_surnames(parsed_names(names, name, lexicon(given)), total))


def remainders(surname: str, from_start: bool) -> list[str]:
    """What a surname has besides one end, with as many letters left out as errors may cost: alike ones share one.

    Both the letters as they are and those with scanning confusions set aside.
    """
    rest = surname[SUFFIX:] if from_start else surname[:-SUFFIX]
    if len(surname) >= LONG:
        return ["*", f"={rest}"]
    most = int(LEFT_OUT * len(surname))
    return sorted({"".join(c) for r in {rest, scanned(rest)} for k in range(min(most, len(r)) + 1) for c in combinations(r, len(r) - k)})


def _remainders(surname: str, end: str) -> Column:
    """`remainders` of two columns, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def rest(s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([remainders(x, y[0] == "<") for x, y in zip(s, e, strict=True)], dtype="object")

    return rest(F.col(surname), F.col(end))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, node columns): the suffixes and beginnings under which a node is looked up, with its initial.

    A typing error leaves one end of a surname whole. Suffixes that remain common with the initial aren't dropped but
    ask for a like surname: pairs of surnames that share a remainder are the keys, found over distinct surnames.
    """
    known = nodes.where("surname <> ''")
    initial = F.substring("given", 1, 1)
    ends = F.array(F.concat(F.lit("<"), F.substring("surname", 1, SUFFIX)), F.concat(F.lit(">"), F.substring(F.col("surname"), -SUFFIX, SUFFIX)))
    each = known.withColumn("__end", F.explode(F.array_distinct(ends))).withColumn("__key", F.concat_ws("|", "__end", initial))
    common = checkpointed(each.groupBy("__key").count().where(f"count > {COMMON}").select("__key"))
    hot = each.join(common, "__key", "left_semi")
    left_out = hot.select("__key", "__end", "surname").distinct().select("__key", "surname", F.explode(_remainders("surname", "__end")).alias("__rest"))
    like = left_out.alias("l").join(left_out.alias("r"), ["__key", "__rest"]).where("l.surname <= r.surname").select("__key", F.col("l.surname").alias("__a"), F.col("r.surname").alias("__b")).distinct()
    refined = like.select("__key", "__a", "__b", F.explode(F.array_distinct(F.array("__a", "__b"))).alias("surname"))
    met = hot.join(refined, ["__key", "surname"]).withColumn("__key", F.concat_ws("|", "__key", "__a", "__b"))
    columns = ["__key", *nodes.columns]
    return each.join(common, "__key", "left_anti").select(columns).unionByName(met.select(columns))


def _level(a: str, b: str) -> Column:
    """`agreement` of two structs of parts, in Arrow batches."""

    @F.pandas_udf("int")
    def level(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        left, right = (list(zip(d["surname"], d["given"], d["middle"], d["second"], d["organisation"], strict=True)) for d in (x, y))
        return pd.Series([agreement(Name(*p), Name(*q), m, n) for p, q, m, n in zip(left, right, x["spellings"], y["spellings"], strict=True)], dtype="int32")

    return level(F.col(a), F.col(b))


def variant_groups(names: DataFrame, name: str) -> DataFrame:
    """(name, group_id): every name that means somebody, with the group of spellings that mean the same one.

    Names are taken apart (order, initials, short forms, honorifics, scanning errors) by what all of them teach about
    given names and second surnames; where nothing tells the two apart, both readings hold. Spellings with the same
    parts are one node, however many there are. Nodes meet under suffixes and beginnings of their surname and the initial,
    and are compared part by part, surnames by longest-common-subsequence ratio. Nodes with a full given name form
    components; one that only has an initial joins the one component it fits, and none if it fits several persons.
    Nulls, empty strings and placeholders mean nobody and have no row; repeated names have one.
    """
    distinct = checkpointed(names.select(F.col(name).alias("name")).where("name is not null").distinct())
    lex = learned(distinct, "name")
    parts = ["surname", "given", "middle", "second", "organisation"]
    parsed = checkpointed(parsed_names(distinct, "name", lex).withColumn("node", F.concat_ws("|", *(F.col(p).cast("string") for p in parts))))
    spellings = parsed.groupBy("surname").agg(F.count(F.lit(1)).cast("int").alias("spellings"))
    nodes = checkpointed(parsed.select("node", *parts, "weak").distinct().join(spellings, "surname"))
    keyed = _keys(nodes).select("__key", F.struct("node", *parts, "weak", "spellings").alias("x"))
    pairs = keyed.alias("l").join(keyed.alias("r"), "__key").where("l.x.node < r.x.node").select(F.col("l.x").alias("x"), F.col("r.x").alias("y")).distinct()
    links = checkpointed(
        pairs.withColumn("level", _level("x", "y")).where("level > 0").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.weak").alias("weak_a"), F.col("y.weak").alias("weak_b"), "level")
    )
    # The readings of one name are one.
    also = parsed.where("reading > 0").select("name", F.col("node").alias("b")).join(parsed.where("reading = 0").select("name", F.col("node").alias("a")), "name").select("a", "b").distinct()
    strong = components(links.where("level = 2 and not weak_a and not weak_b").select("a", "b").unionByName(also))
    strong = nodes.where("not weak").select("node").join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    mixed = links.where("weak_a <> weak_b").select(F.when(F.col("weak_a"), F.col("a")).otherwise(F.col("b")).alias("node"), F.when(F.col("weak_a"), F.col("b")).otherwise(F.col("a")).alias("to"))
    fits = mixed.join(strong.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    alone = nodes.where("weak").select("node").join(fits, "node", "left_anti")
    both_alone = links.where("weak_a and weak_b").join(alone.withColumnRenamed("node", "a"), "a", "left_semi").join(alone.withColumnRenamed("node", "b"), "b", "left_semi")
    rest = alone.join(components(both_alone), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    # A node that fits several persons gets none of them, and no group.
    group = strong.unionByName(fits.where("component = other").select("node", "component")).unionByName(rest)
    return parsed.where("reading = 0").select("name", "node").join(group, "node").select("name", F.sha2("component", 256).alias("group_id"))


def variant_pairs(names: DataFrame, name: str) -> DataFrame:
    """(name_a, name_b): pairs of different spellings of one person or organisation, the smaller by code points first."""
    groups = variant_groups(names, name)
    a, b = groups.select("group_id", F.col("name").alias("name_a")), groups.select("group_id", F.col("name").alias("name_b"))
    return a.join(b, "group_id").where("name_a < name_b").select("name_a", "name_b")
