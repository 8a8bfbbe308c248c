"""The language of each document and of each stretch in another language, with a confidence."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.llm.cross_parsing import CrossParser, parser_of
from biblioflow.llm.words import mended, plain

# The notations in which a label names a language.
NAMES = {
    "es": ["es", "spa", "español", "espanol", "castellano", "spanish"],
    "en": ["en", "eng", "english", "inglés", "ingles"],
    "fr": ["fr", "fra", "fre", "french", "francés", "frances", "français"],
    "de": ["de", "deu", "ger", "german", "alemán", "aleman", "deutsch"],
    "it": ["it", "ita", "italian", "italiano"],
    "pt": ["pt", "por", "portuguese", "portugués", "portugues", "português"],
    "ca": ["ca", "cat", "catalan", "catalán", "català"],
}
# Whole texts that stand for none, and marks of a text that was cut off.
PLACEHOLDERS = ["sin descripción", "sinopsis pendiente", "no description available", "descripción no disponible por el momento", "lorem ipsum dolor sit amet", "n/a", "null", "none"]
CUT = re.compile(r"\s*(?:\(más\)|\[\.\.\.\]|\[…\]|leer más|read more|…|\.\.\.)\s*$")

SAMPLE = 400  # distinct labelled texts per language that a fit looks at
SAMPLE_CHARS = 2_000  # of each such text
TRAIN_CHARS = 30_000  # of cleaned sentences per language in its automaton
LEAST_WORDS = 3  # of a segment
LETTERS = re.compile(r"[^\W\d_]+")
FOREIGN = re.compile(r"[^\W\d_A-Za-zªµºÀ-ɏ]")  # letters of a script that none of the languages is written in
BLOCK = re.compile(r"<(?:br|/?p|/?div|/?li|/?h\d)\b[^<>]*>", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?…])[\"»”')\]]*\s+|[\n\r]+")
# A quotation without the end of a sentence inside is a title.
TITLE = re.compile(r"«[^«».!?…]*»|“[^“”.!?…]*”|„[^„“”.!?…]*[“”]|\"[^\".!?…]*\"")


def label_code(c: Column) -> Column:
    """Two-letter code that a label names, or null: any case, region suffixes and catalogue prefixes allowed."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"^/languages/", "")
    codes = F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)))
    return F.coalesce(codes[name], codes[F.regexp_extract(name, r"^([a-z]{2,3})[-_][a-z0-9]+$", 1)])


def segments(text: str | None) -> list[str]:
    """Sentences, or their beginnings, of three words or more; markup, quoted titles and placeholders hold none, and
    neither do sentences most of whose letters are of another script than the languages'."""
    if not text:
        return []
    text = plain(BLOCK.sub("\n", mended(text)))
    if text.strip().strip(".").strip().lower() in PLACEHOLDERS:
        return []
    found = []
    for s in SENTENCE.split(TITLE.sub(" ", text)):
        s = CUT.sub("", s).strip()
        if len(LETTERS.findall(s)) >= LEAST_WORDS and (not (other := FOREIGN.findall(s)) or 2 * len(other) <= sum(map(str.isalpha, s))):
            found.append(s)
    return found


def cleaned(labelled: dict[str, list[list[str]]], rounds: int = 4) -> dict[str, list[str]]:
    """Distinct sentences by the language they are in, from texts (their sentences) by a label that is often wrong.

    Wrong labels scatter over the languages, so the words of each language still go with its own label most. Each
    sentence goes to the label whose share of its words is largest, its own count aside; then the shares are taken
    anew. A sentence that stands under several labels (a notice that goes with any book) is judged at the end: by
    the letters of the others, as the texts that it stands in are.
    """
    labels = sorted(labelled)
    under: dict[str, np.ndarray] = {}
    for k, label in enumerate(labels):
        for s in (s for text in labelled[label] for s in text):
            under.setdefault(s, np.zeros(len(labels)))[k] += 1
    pool = sorted(under, key=lambda s: (zlib.crc32(s.encode()), s))
    words = [sorted(set(LETTERS.findall(s.lower()))) for s in pool]
    first = np.array([under[s] / under[s].sum() for s in pool]).reshape(-1, len(labels))
    weight = first
    for _ in range(rounds):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(labels)))
        size = weight.sum(axis=0) + 1
        for w, own in zip(words, weight, strict=True):
            for x in w:
                counts[x] += own
        after = np.zeros_like(weight)
        for row, (w, own) in enumerate(zip(words, weight, strict=True)):
            others = [c for x in w if (c := counts[x] - own).sum() > 0.5]
            score = np.log((np.array(others) + 0.5 * size / size.sum()) / size).sum(axis=0) if others else first[row]
            after[row, score.argmax()] = 1
        if (after == weight).all():
            break
        weight = after
    owner = weight.argmax(axis=1)
    several = (first > 0).sum(axis=1) > 2
    sure = {label: [s for s, k, x in zip(pool, owner, several, strict=True) if labels[k] == label and not x] for label in labels}
    rest = {s for s, x in zip(pool, several, strict=True) if x}
    texts = [t for label in labels for t in labelled[label] if not rest.isdisjoint(t)]
    if texts and all(sure.values()):
        parser = CrossParser({label: take(v, TRAIN_CHARS) for label, v in sure.items()})
        bits, lengths = parser.phrases([s for t in texts for s in t])
        bits = bits * lengths[:, None]
        votes = defaultdict(lambda: np.zeros(len(labels)))
        best, _ = decide(bits, parser.bits, [len(t) for t in texts], slack=4)
        for s, k in zip((s for t in texts for s in t), best, strict=True):
            votes[s][k] += s in rest
        for s in sorted(rest):
            sure[labels[votes[s].argmax()]].insert(0, s)
    return sure


def take(sentences: list[str], chars: int) -> list[str]:
    """The first sentences that make up `chars` characters."""
    return sentences[: int(np.searchsorted(np.cumsum([len(s) for s in sentences]), chars)) + 1]


def training_text(labelled: dict[str, list[list[str]]]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """At most TRAIN_CHARS of sentences per language: some at random, then those that these explain worst."""
    pools = cleaned(labelled)
    first = {label: take(pool, TRAIN_CHARS * 2 // 5) for label, pool in pools.items()}
    parser = CrossParser(first)
    text = []
    for k, label in enumerate(parser.labels):
        rest = pools[label][len(first[label]) :]
        bits, _ = parser.phrases(rest)
        rest = [rest[i] for i in np.argsort(-bits[:, k], kind="stable")] if rest else []
        text.append((label, tuple(first[label] + take(rest, TRAIN_CHARS * 3 // 5))))
    return tuple(text)


def fit(texts: DataFrame, text: str, label: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Labelled text for the automata, from at most about SAMPLE distinct texts per language, chosen by their hash."""
    known = texts.select(F.substring(text, 1, SAMPLE_CHARS).alias("__t"), label_code(F.col(label)).alias("__c")).where("__c is not null and length(__t) > 20")
    sizes = {r["__c"]: r["n"] for r in known.groupBy("__c").agg(F.approx_count_distinct("__t").alias("n")).collect()}
    if not sizes:
        return ()
    share = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, 1.2 * SAMPLE / n))))
    chance = F.pmod(F.xxhash64("__t", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    rows = known.where(chance < share[F.col("__c")]).distinct().orderBy(F.xxhash64("__t"), "__t", "__c").limit(2 * SAMPLE * len(NAMES)).collect()
    labelled: dict[str, list[list[str]]] = defaultdict(list)
    for r in rows:
        labelled[r["__c"]].append(segments(r["__t"]))
    return training_text(labelled)


def decide(bits: np.ndarray, phrase: np.ndarray, sizes: list[int], slack: float = 1.05) -> tuple[np.ndarray, np.ndarray]:
    """Language of each segment, and its probability, from the bits it takes in each language; `sizes` are the segments
    of each text, all positive.

    Between languages no further apart than one phrase (`slack`), the one that the whole text takes fewest bits in holds.
    """
    if not len(bits):
        return np.zeros(0, dtype=int), np.zeros(0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), axis=0)
    main, rows = whole.argmin(axis=1)[owner], np.arange(len(bits))
    least = bits.min(axis=1)
    best = np.where(bits[rows, main] - least <= phrase[main] * slack, main, bits.argmin(axis=1))
    # Phrases aren't independent evidence: a quarter of their bits counts, and the whole text weighs in for ties.
    tie = np.exp2(-np.minimum((whole - whole.min(axis=1, keepdims=True)) / 16, 2))[owner]
    odds = np.exp2(-np.minimum((bits - least[:, None]) / 4, 60)) * tie
    return best, odds[rows, best] / odds.sum(axis=1)


SCHEMA = "key long, label string, stretch int, language string, confidence double, words int, text string"


def language_stretches(texts: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, label, stretch, language, confidence, words, text): the stretches of each text that are in one language;
    `label` is the code that the text's own label names, or null.

    The labelled texts themselves, most of which are labelled right, make the languages known: a bounded sample is
    cleaned of wrong labels and put into one suffix automaton per language. Each sentence is then parsed into longest
    matches of each language; the language that needs fewest normalised phrases wins. Neighbouring sentences of a
    language make a stretch; its confidence is their mean by words. Texts are judged where they lie, without a shuffle.
    Null, empty and placeholder texts have no stretch; rows without a key are left out; equal rows give equal
    results; without any labelled text there is no language to find. Other columns are ignored.
    """
    spark = texts.sparkSession
    model = spark.sparkContext.broadcast(fit(texts, text, label))  # at most 7 * TRAIN_CHARS characters and a sentence

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = parser_of(model.value)
        for batch in batches:
            parts = [segments(t) for t in batch["text"]]
            place = {s: k for k, s in enumerate(dict.fromkeys(s for p in parts for s in p))}  # each different sentence is parsed once
            bits, lengths = parser.phrases(list(place))
            rows, at = [], 0
            if parser.labels:
                best, sure = decide((bits * lengths[:, None])[[place[s] for p in parts for s in p]], parser.bits, [len(p) for p in parts if p])
                best, sure = best.tolist(), sure.tolist()
                for key_, code, part in zip(batch["key"], batch["label"], parts, strict=True):
                    to = at + len(part)
                    rows += [(key_, code, n, *x) for n, x in enumerate(stretches(part, best[at:to], sure[at:to], parser.labels))]
                    at = to
            yield pd.DataFrame(rows, columns=["key", "label", "stretch", "language", "confidence", "words", "text"])

    rows = texts.select(F.col(key).alias("key"), label_code(F.col(label)).alias("label"), F.col(text).alias("text"))
    found = rows.where("key is not null and text is not null").mapInPandas(judge, SCHEMA)
    return found.withColumnRenamed("key", key)


def stretches(parts: list[str], best: list[int], sure: list[float], labels: list[str]) -> list[tuple[str, float, int, str]]:
    """(language, confidence, words, text) of each run of segments in one language."""
    out: list[list] = []
    for s, k, p in zip(parts, best, sure, strict=True):
        n = len(LETTERS.findall(s))
        if out and out[-1][0] == labels[k]:
            out[-1][1] += p * n
            out[-1][2] += n
            out[-1][3].append(s)
        else:
            out.append([labels[k], p * n, n, [s]])
    return [(lang, p / n, n, " ".join(s)) for lang, p, n, s in out]


def languages_present(texts: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, language, confidence, words, labelled): one row per text and language, `words` being how many are in it,
    `labelled` whether every label of the text names it."""
    by = language_stretches(texts, key, text, label).groupBy(key, "language")
    right = F.coalesce(F.col("label") == F.col("language"), F.lit(False))
    return by.agg((F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"), F.sum("words").alias("words"), F.min(right).alias("labelled"))
