"""Combining sources so that each makes up a target share of all tokens, small sources repeated up to a cap."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.sources.shared import checkpointed

TOKENIZER = os.environ.get("BIBLIOFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
SLICES = 1 << 16  # of each source, by seeded hash; a fractional repetition is a number of whole slices
MOST_SOURCES = 10_000  # that a mix may name; their totals are what the driver holds


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # in a text they are ordinary text
    return t


def with_tokens(texts: DataFrame, text: str = "text", to: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """`texts` with the number of tokens of a public tokenizer; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = _tokenizer(path)
        for s in batches:
            yield pd.Series([len(e) for e in t.encode_batch_fast([x or "" for x in s], add_special_tokens=False)], dtype="int64")

    return texts.withColumn(to, count(F.col(text)))


def source_name(c: Column) -> Column:
    """A source's one spelling: lower case without surrounding blanks, dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


@dataclass(frozen=True)
class Part:
    """What a source gives to a mix: `epochs` = whole repetitions and a fraction of its size."""

    source: str
    target: float
    most: int
    size: int
    wanted: float

    @property
    def epochs(self) -> float:
        return min(self.most, self.wanted / self.size) if self.size else 0.0


def fill(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None) -> list[Part]:
    """Capped water-filling: sources that can't give their share within their cap give all they can, and what is
    missing goes to the others in proportion to their weights, until every share is feasible or every source is full.

    `total` is the size of the mix, by default that of all sources named. Weights count relative to one another;
    those of sources without text, or that are null or not positive, are 0.
    """
    rows = {s: (max(w or 0.0, 0.0), max(m or 0, 0), sizes.get(s, 0)) for s, w, m in targets}
    total = float(sum(n for _, _, n in rows.values())) if total is None else float(total)
    given, free, left = {}, {s for s, (w, m, n) in rows.items() if w > 0 and m * n > 0}, total
    while free:
        weight = sum(rows[s][0] for s in free)
        full = {s for s in free if left * (rows[s][0] / weight) >= rows[s][1] * rows[s][2]}
        if not full:
            given |= {s: left * (rows[s][0] / weight) for s in free}
            break
        for s in full:
            given[s] = float(rows[s][1] * rows[s][2])
        left -= sum(given[s] for s in full)
        free -= full
    return [Part(s, w, m, n, given.get(s, 0.0)) for s, (w, m, n) in rows.items()]


def _slice(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(SLICES)).cast("int")


def plan(texts: DataFrame, targets: DataFrame, key: str, text: str, source: str, seed: int = 1, total: float | None = None, path: str = TOKENIZER) -> DataFrame:
    """(source, target_share, max_repeats, tokens, epochs, repeats, last_slice, mixed_tokens): how to make the mix.

    Tokens are counted once and summed by source and slice, before the shuffle, so a source that holds most rows
    is no hot spot; the driver gets one total per source named in `targets` (MOST_SOURCES at most).
    """
    spark = texts.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in a mix")
    named = {r.s: (r.s, r.target_share, r.max_repeats) for r in rows}
    kept = texts.select(key, text, source_name(F.col(source)).alias("__s")).where(F.col("__s").isin(*named) if named else F.lit(False))
    slices = with_tokens(kept.withColumn("__slice", _slice(key, seed)), text, "__n", path).groupBy("__s", "__slice").agg(F.sum("__n").alias("__n"))
    slices = checkpointed(slices)  # at most SLICES rows a source
    sizes = {r["__s"]: r["__n"] for r in slices.groupBy("__s").agg(F.sum("__n").alias("__n")).collect()}
    parts = fill(list(named.values()), sizes, total)
    table = [(p.source, float(p.target), int(p.most), int(p.size), float(p.epochs), int(p.epochs + 1e-9)) for p in parts]
    chosen = spark.createDataFrame(table, "source string, target_share double, max_repeats int, tokens bigint, epochs double, repeats int")
    running = slices.withColumn("__sum", F.sum("__n").over(Window.partitionBy("__s").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)))
    within = (F.col("epochs") - F.col("repeats")) * F.col("tokens")
    cut = (
        running.join(F.broadcast(chosen), F.col("__s") == F.col("source"))
        .where((within > 1e-6) & (F.col("__sum") - F.col("__n") / 2 <= within))  # as near to the fraction as whole slices come
        .groupBy("source")
        .agg(F.max("__slice").alias("last_slice"), F.max("__sum").alias("__part"))
    )
    return chosen.join(cut, "source", "left").select(
        *chosen.columns, F.coalesce("last_slice", F.lit(-1)).alias("last_slice"), (F.col("repeats") * F.col("tokens") + F.coalesce("__part", F.lit(0))).alias("mixed_tokens")
    )


def mix(texts: DataFrame, targets: DataFrame, key: str, text: str, source: str, seed: int = 1, total: float | None = None, path: str = TOKENIZER) -> DataFrame:
    """(key, source, copy INT, text): the mixed rows, a document used several times once per copy.

    Each source gives its whole repetitions, and of one more those documents whose seeded hash falls into the first
    slices that make up the fraction; the same seed gives the same rows. Documents of no named source (null among
    them) are left out; a source with a cap of 0, without text or without weight gives nothing; equal rows are
    taken alike. The plan has one row a source, so the documents aren't shuffled.
    """
    chosen = plan(texts, targets, key, text, source, seed, total, path).select("source", "repeats", "last_slice")
    rows = texts.select(F.col(key), F.col(text), source_name(F.col(source)).alias("source")).withColumn("__slice", _slice(key, seed))
    copies = F.col("repeats") + (F.col("__slice") <= F.col("last_slice")).cast("int")
    mixed = rows.join(F.broadcast(chosen), "source").withColumn("__copies", copies).where("__copies > 0")
    return mixed.select(key, "source", F.explode(F.sequence(F.lit(1), "__copies")).alias("copy"), text)


def shares(texts: DataFrame, targets: DataFrame, key: str, text: str, source: str, seed: int = 1, total: float | None = None, path: str = TOKENIZER) -> DataFrame:
    """(source, target_share, max_repeats, tokens, epochs, mixed_tokens, actual_share): the shares that `mix` reaches."""
    done = plan(texts, targets, key, text, source, seed, total, path)
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    share = F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0)
    return done.select("source", "target_share", "max_repeats", "tokens", "epochs", "mixed_tokens", share.alias("actual_share"))
