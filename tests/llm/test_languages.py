import random

import numpy as np

from biblioflow.llm.cross_parsing import SIZE, STOP, CrossParser, encode, suffix_automaton
from biblioflow.llm.languages import label_code, language_stretches, languages_present, segments
from pyspark.sql import functions as F


def naive_phrases(text, known):
    """Phrases by looking every longest match up in the labelled text."""
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in known:
            n += 1
        count += 1
        at += max(n, 1)
    return count


def test_automaton_holds_exactly_the_substrings():
    r = random.Random(2)
    s = [r.randrange(1, 4) for _ in range(40)]
    table = suffix_automaton(s)
    parts = {tuple(s[i:j]) for i in range(41) for j in range(i + 1, 41)}
    for _ in range(500):
        t = tuple(r.randrange(1, 4) for _ in range(r.randrange(1, 9)))
        state = 0
        for c in t:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (t in parts)
    assert table.shape[1] == SIZE


def test_phrases_equal_naive():
    texts = {"a": ["el faro rojo", "la casa vieja del faro"], "b": ["the red house", "a lighthouse"]}
    parser = CrossParser(texts)
    queries = ["el faro viejo", "the old house", "zzz", "", "casa"]
    bits, lengths = parser.phrases(queries)
    for k, label in enumerate(parser.labels):
        known = "".join(chr(x) for s in texts[label] for x in [STOP, *encode(s).tolist()]) + chr(STOP)
        for q, row, n in zip(queries, bits, lengths, strict=True):
            coded = "".join(chr(x) for x in encode(q).tolist())
            got = round(row[k] * n / parser.bits[k])
            assert got == naive_phrases(coded, known)


def test_segments():
    assert segments("<p>El faro rojo brilla.</p>Luego «The red house» calla (más)") == ["El faro rojo brilla."]
    assert segments("Sin descripción.") == segments(None) == segments("") == segments("Lorem ipsum dolor sit amet.") == []
    assert segments("Это не латинское письмо. 這 不 是. La casa се duerme.") == ["La casa се duerme."]
    assert segments("La casa azul duerme… El perro negro la") == ["La casa azul duerme", "El perro negro la"]


WORDS = {
    "es": ("el la un su faro casa perro mar luna rey sol viento rojo azul mira busca teme guarda recuerda y con sin sobre hacia", "es castellano /languages/spa"),
    "en": ("the a his this lighthouse house dog sea moon king sun wind red blue watches seeks fears keeps remembers and with without over towards", "en en-GB English"),
    "de": ("der die das ein sein leuchtturm haus hund meer mond könig sonne wind rot blau sieht sucht fürchtet hütet und mit ohne über gegen", "de ger alemán"),
}


def sentence(r, lang, n=7):
    return " ".join(r.choice(WORDS[lang][0].split()) for _ in range(n)).capitalize() + "."


def test_accuracy_and_mixtures(spark):
    r = random.Random(5)
    rows, truth = [], {}
    for k in range(300):
        lang = r.choice(list(WORDS))
        label = r.choice(WORDS[lang][1].split() if r.random() < 0.8 else [None, "xx", *WORDS[r.choice(list(WORDS))][1].split()])
        parts = [sentence(r, lang) for _ in range(5)]
        truth[k] = {lang}
        if k % 5 == 0:
            other = r.choice([x for x in WORDS if x != lang])
            parts.insert(r.randrange(1, 5), sentence(r, other, 9))
            truth[k].add(other)
        rows.append((k, " ".join(parts), label, 1.0))
    rows += [(400, None, "es", 1.0), (401, "", "es", 1.0), (402, "N/A", "en", 1.0), (None, rows[0][1], "es", 1.0), (403, rows[0][1] + " " + "palabra " * 5000, "es", 1.0)]
    df = spark.createDataFrame(rows, "id long, text string, label string, confidence double")
    found = languages_present(df, "id", "text", "label").collect()
    got = {}
    for x in found:
        got.setdefault(x.id, set()).add(x.language)
        assert 0 <= x.confidence <= 1
    right = sum(got.get(k) == v for k, v in truth.items())
    assert right >= 0.97 * len(truth)
    assert not {400, 401, 402, None} & set(got)
    stretches = language_stretches(df, "id", "text", "label").where("id = 0").orderBy("stretch").collect()
    assert len(stretches) == 3 or len({s.language for s in stretches}) == 2
    assert languages_present(df.where("false"), "id", "text", "label").collect() == []
    assert languages_present(df.withColumn("label", F.lit(None).cast("string")), "id", "text", "label").collect() == []


def test_labels(spark):
    labels = {"es-MX": "es", "/languages/fre": "fr", "Català": "ca", "xx": None, "": None, "en_US": "en", "unknown": None, "português": "pt"}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r.l: r.c for r in df.select("l", label_code(F.col("l")).alias("c")).collect()} == labels


def test_empty_parser():
    bits, lengths = CrossParser({}).phrases(["abc"])
    assert bits.shape == (1, 0) and np.all(lengths == 5)
