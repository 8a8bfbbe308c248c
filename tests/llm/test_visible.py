from types import SimpleNamespace

import pytest
from py4j.protocol import Py4JError

from biblioflow.llm.visible import consistent_form, look_alike_classes, look_alike_letters, look_alike_pairs, skeleton

SAME = ["Café sol", "Ｃａｆé sol", "Café sol", "Cаfé sоl", "Ca​fé­sol".replace("­", " "), "Café sol", "Café s­ol"]
OTHER = ["Cafe sol", "café sol", "Café, sol", "Café  sol", "Café\nsol", None, ""]


def test_skeleton():
    assert len({skeleton(s) for s in SAME}) == 1
    assert len({skeleton(s) for s in [*SAME, *OTHER]}) == 1 + len(OTHER)
    assert skeleton("ﬁn ½ 1º x²") == "fin ½ 1º x²" and skeleton("a‑b‐c") == "a-b-c" and skeleton("𝐀ｂ") == "Ab"
    assert skeleton("\x00a‍") == "a" and skeleton(skeleton("Ｃàｆé")) == skeleton("Ｃàｆé")


def test_pairs_and_classes(spark):
    rows = [(k, s, "x") for k, s in enumerate([*SAME, *OTHER, SAME[0], "x" * 200_000 + "а", "x" * 200_000 + "a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    want = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and a is not None and b is not None and a != b and skeleton(a) == skeleton(b)}
    got = [tuple(r) for r in look_alike_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    classes = look_alike_classes(df).collect()
    links = {k: sum(k in p for p in want) for k in {k for p in want for k in p}}
    assert {r.doc_id: r.links for r in classes} == links
    assert {r.doc_id for r in classes} == {k for p in want for k in p} and len({r.class_id for r in classes}) == 2
    forms = {r.doc_id: r.consistent for r in consistent_form(df).collect()}
    assert forms[1] == "Café sol" and forms[len(SAME) + 5] is None and forms[len(SAME) + 6] == ""
    assert look_alike_pairs(df.where("false")).collect() == []


def test_public_table(spark):
    letters = look_alike_letters(spark)
    for ch, like in {"Ꭺ": "A", "Ꮃ": "W", "γ": "y", "σ": "o", "հ": "h", "ո": "n", "ѵ": "v", "ҽ": "e", "Ⲟ": "O", "ꓮ": "A", "ᴏ": "o", "І": "I", "Ӏ": "I", "ւ": "ւ", "Г": "Γ"}.items():
        assert skeleton(ch, letters) == skeleton(like, letters)
    for a, b in ("Il", "l1", "O0", ("rn", "m"), ("–", "-"), ("“", '"'), ("б", "6"), ("æ", "ae"), ("в", "B"), ("к", "k"), ("é", "e")):
        assert skeleton(a, letters) != skeleton(b, letters)
    assert 300 < len(letters) < 5000 and skeleton("Γ", letters) == "Γ"


def test_missing_table_is_an_error():
    """Without the public table there is no result instead of a smaller one."""

    def fails():
        raise Py4JError("no ICU")

    package = SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=fails)))
    absent = SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=None)))  # not callable, as py4j has a class that isn't there
    for jvm in (None, *(SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=x))) for x in (package, absent))):
        with pytest.raises(RuntimeError, match="look-alike letters"):
            look_alike_letters(SimpleNamespace(_jvm=jvm))
