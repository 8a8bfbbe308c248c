import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from biblioflow.llm import survivors as s

WHOLE = "El faro guarda la isla. El mar la busca cada noche."


@pytest.fixture(scope="module")
def quality(spark):
    def of(f, values, kind):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
        return [r.q for r in df.select("k", f(F.col("v")).alias("q")).orderBy("k").collect()]

    return of


def test_description(quality):
    bad = [None, "", "Sin descripción", "N/A", WHOLE[:-1], WHOLE[:20] + "…", WHOLE + " (más)", "El pequeÃ±o faro guarda la isla.", "Nuestra tienda ofrece miles de títulos. Puedes pagar con tarjeta.", "<p> </p>"]
    assert quality(s.description_quality, bad, "string") == [None] * len(bad)
    assert quality(s.description_quality, [WHOLE, f"<div><b>{WHOLE}</b></div>", "¿Y el faro?"], "string") == [51.0, 51.0, 11.0]


def test_other_fields(quality):
    names = ["Editorial Pabrival", "Ed. Pabrival", "Penguin Random House", "Sin editorial", "Librería y Ed…", " Éditions  Gallimard ", "St. Martin's Press", "Conversor EpubForja 3.2 (edición automática)", None, "?"]
    assert quality(s.publisher_quality, names, "string") == [18.0, None, 20.0, None, None, 18.0, 18.0, None, None, None]
    assert quality(s.page_count_quality, [20.0, 5000.0, 19.0, 5001.0, 173.5, -1.0, float("nan"), None], "double") == [1.0, 1.0, None, None, None, None, None, None]
    lists = [["Terror", " terror", "TERROR", None], ["Terror; Humor", "Terror"], ["kindle", "to-read", "read-in-2021"], [], None, ["a / b / c", "d -- e"]]
    assert quality(s.subjects_quality, lists, "array<string>") == [1.0, 2.0, None, None, None, 5.0]


ROWS = "g string, r long, source string, t timestamp, v double, field string"


def survivors(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return {x.g: x.r for x in s.surviving_values(df, "g", "r", [s.Field("v", F.col("v"))], "source", "t").collect()}


def test_currency(spark):
    t = lambda d: datetime(2024, 1, d)
    learned = [(f"k{n}", 100 * n + k, src, t(k + 1), None, "") for n in range(1, 4) for k, src in enumerate(("epub", "web", "shop"))]
    df = spark.createDataFrame(learned, ROWS)
    ranks = s.precedence(df, "g", "source", "t")
    ranks = {x.state: x["rank"] for x in ranks.collect()}
    assert ranks["epub"] < ranks["web"] < ranks["shop"]
    rows = learned + [
        ("dated", 1, "shop", t(1), 1.0, ""), ("dated", 2, "epub", t(2), 1.0, ""), ("undated", 3, "web", t(9), 1.0, ""), ("undated", 4, "shop", None, 1.0, ""), ("older", 5, "web", t(9), 1.0, ""), ("older", 6, "epub", None, 1.0, ""),
        ("better", 7, "epub", None, 2.0, ""), ("better", 8, "shop", t(9), 1.0, ""), ("tie", 10, "web", t(1), 1.0, ""), ("tie", 9, "web", t(1), 1.0, ""), ("tie", 9, "web", t(1), 1.0, ""), ("alone", 11, "web", t(1), 1.0, ""), ("alone", 11, "web", t(2), 1.0, ""),
        ("none", 12, "web", t(1), None, ""), ("none", 13, "web", t(1), None, ""), (None, 14, "web", t(1), 1.0, ""), (None, 15, "web", t(1), 1.0, ""), ("odd", 16, None, None, 1.0, ""), ("odd", 17, "new", None, 1.0, ""),
    ]
    assert survivors(spark, rows) == {"dated": 2, "undated": 4, "older": 5, "better": 7, "tie": 9, "odd": 16}
    assert survivors(spark, []) == {}


def test_times_left_out(spark):
    """Where times are taken away, the learned precedence finds the value that is latest by them."""
    r = random.Random(8)
    order, rows, latest = ["scan", "epub", "web", "shop"], [], {}
    for g in range(200):
        found = sorted(r.sample(range(4), 3))
        if r.random() < 0.05:
            found = found[::-1]  # some groups go the other way
        for k, state in enumerate(found):
            rows.append((f"g{g}", 10 * g + k, order[state], datetime(2024, 1, 1 + k) if g % 2 else None, 1.0, ""))
        latest[f"g{g}"] = max((order.index(x[2]), x[1]) for x in rows[-3:])[1] if not g % 2 else 10 * g + 2
    assert survivors(spark, rows) == latest


def test_short_names(spark):
    names = ["Editorial Pabrival"] * 5 + ["Editorial Pabri"] * 2 + ["Editorial Mata"] * 2 + ["Ed. Mata"] + ["Editorial Matafuz"] * 3 + ["Torul Publishing House", None, "x"]
    names += ["Torul", "Torul Publishing", "Grupo Editorial Sumar", "Grupo Sumar", "Anagrama", "Editorial"]
    df = spark.createDataFrame([(n, 1) for n in names], "publisher string, count int")
    assert sorted(r.publisher for r in s.short_names(df, "publisher").collect()) == ["Editorial", "Editorial Pabri", "Grupo Sumar", "Torul", "Torul Publishing"]
    assert s.short_names(df.where("false"), "publisher").collect() == []
