import random

from biblioflow.llm import variants
from biblioflow.llm.components import components
from biblioflow.llm.names import agreement, lcs, lexicon, parse, ratio, readings
from biblioflow.llm.variants import variant_groups, variant_pairs

FAMILIES = lexicon(frozenset({"etienne", "karl"}), frozenset({"plenosa", "zumalde"}))
RUIBOL = ["Francisco James Brutraflavil", "Brutraflavil, francisco", "Dr. Francisco Brutraflavil", "por Paco Brutraflavil", "Francisco_Brutraflavil", "Francisco, Brutraflavil", "FJ Brutraflavil", "Brutraflavil Francisco (Autor)", "Franc1sco Brutraf1avil", "Francisco Brutarflavil"]


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(12))) for _ in "ab")
        assert lcs(a, b) == naive_lcs(a, b)
    assert ratio("crafornavo", "crafomavo") > 0.95


def test_parts():
    assert parse("Sebuflodril Cremonde, Étienne")[:2] == ("sebuflodril", "etienne")
    assert parse("Plesedagran Z., William", FAMILIES)[:4] == ("plesedagran", "william", "", "z")
    assert parse("Karl Besotonal y Zumalde", FAMILIES)[:4] == ("besotonal", "karl", "", "zumalde")
    assert parse("Vic. Prafagrenun").given == "vic" and parse("Vic Prafagrenun").given == "victor"
    assert parse("Fund. Busucropraz p/ la Lectura") == parse("Busucropraz, Fundación") == parse("Fundación Busucropraz")
    assert parse("SR Taprullafo")[:3] == ("taprullafo", "s", "r") and parse("EL Sonefino")[:3] == ("sonefino", "e", "l") and parse("Dr. Karl Sonefino")[:3] == ("sonefino", "karl", "")
    for nobody in (None, "", " ", "AA. VV.", "n/a", "Autor desconocido", "Unknown", "???"):
        assert parse(nobody) is None


def test_agreement():
    first = parse(RUIBOL[0], FAMILIES)
    assert all(agreement(first, parse(x, FAMILIES)) == (1 if x.startswith("FJ") else 2) for x in RUIBOL)
    for other in ("Ximena Brutraflavil", "Francisco Miguel Brutraflavil", "Francisco Crobrasódon", "Fundación Brutraflavil"):
        assert agreement(first, parse(other, FAMILIES)) == 0


def best(a, b):
    return max((agreement(x, y) for x in readings(a) for y in readings(b)), default=0)


def test_names_outside_any_list():
    pairs = [("Hiroshi Tanaka", "Tanaka Hiroshi"), ("Daniel Petrov", "Petrov Daniel"), ("Gabriel García Márquez", "García Márquez, Gabriel"), ("Cervantes", "Cervantez"), ("Pérez, Juan", "Juan Pérez"), ("Tanaka, Hiroshi", "Hiroshi Tanaka")]
    assert all(best(a, b) == 2 for a, b in pairs)
    assert best("Michael Johnson", "Mike Johnson") == 2 and best("Jennifer Smith", "Jenny Smith") == 1 and best("Daniel Petrov", "Danny Petrov") == 1
    assert not any(best(a, b) for a, b in [("Hiroshi Tanaka", "Kenji Tanaka"), ("Gabriel García Márquez", "Juan García Márquez"), ("Cervantes", "Miguel Cervantes"), ("Jennifer Smith", "Jessica Smith"), ("Homer", "Hesse")])


def test_learned_names(spark):
    given, surnames = ["hiroshi", "aiko", "daisuke", "ilse", "bruno"], [f"{a}{b}moto" for a in "kstnhm" for b in "aiueo"]
    r = random.Random(2)
    names = [f"{g} {s}".title() for g in given for s in r.sample(surnames, 12)] + [f"{s}, {g}".title() for g in given for s in r.sample(surnames, 3)] + ["Ilse Aiko Kamoto", "Fundación Kamoto", "Hirosh Tumoto"]
    lex = variants.learned(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert lex.given == set(given)
    assert parse("Kamoto Aiko", lex)[:2] == ("kamoto", "aiko") and parse("Ilse Aiko Kamoto", lex)[:3] == ("kamoto", "ilse", "aiko") and lex.known("hirosh") == "hiroshi"
    assert variants.learned(spark.createDataFrame([], "name string"), "name").given == frozenset()


def test_groups_outside_any_list(spark):
    names = ["Hiroshi Tanaka", "Tanaka Hiroshi", "Tanaka, Hiroshi", "Kenji Tanaka", "Gabriel García Márquez", "García Márquez, Gabriel", "Mike Johnson", "Michael Johnson", "Jennifer Smith", "Jenny Smith", "Cervantes", "Cervantez"]
    got = {tuple(r) for r in variant_pairs(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert got == {tuple(sorted(p)) for p in [names[:2], names[1:3], (names[0], names[2]), names[4:6], names[6:8], names[8:10], names[10:12]]}


def test_groups(spark):
    relatives = ["Ximena Brutraflavil", "X. Brutraflavil", "Jesús Brusudrivun", "José Brusudrivun", "J. Brusudrivun", "Pepe Brusudrivun"]
    rows = [(n, 1) for n in [*RUIBOL, *relatives, "Unknown", "", None, "AA. VV.", RUIBOL[0], "x" * 5000]]
    df = spark.createDataFrame(rows, "name string, node int")
    pairs = {tuple(r) for r in variant_pairs(df, "name").collect()}
    want = {tuple(sorted((a, b))) for a in RUIBOL for b in RUIBOL if a != b}
    want |= {("X. Brutraflavil", "Ximena Brutraflavil"), ("José Brusudrivun", "Pepe Brusudrivun")}  # "J." may be either brother
    assert pairs == want
    groups = variant_groups(df, "name").collect()
    assert len(groups) == len({r.name for r in groups}) and "Unknown" not in {r.name for r in groups}
    assert variant_pairs(df.where("false"), "name").collect() == []


def test_components(spark):
    r = random.Random(9)
    edges = [(f"c{k}", f"c{k + 1}") for k in range(40)] + [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(40)] + [(None, "q"), ("s", "s"), ("c3", "c2")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_remainders():
    """Like surnames that share an end share a remainder."""
    r = random.Random(4)
    for _ in range(400):
        a = "".join(r.choice("aeiourmnstlc") for _ in range(r.randrange(5, 17)))
        b = list(a)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice(["", "x", "xy", b[k] + "n"])
        b = "".join(b)
        if 5 <= len(b) <= 16 and ratio(a, b) >= 0.82 and a[:4] == b[:4] and 2 * lcs(a, b) / (len(a) + len(b)) >= 0.82:
            assert set(variants.remainders(a, True)) & set(variants.remainders(b, True)), (a, b)
    assert len(variants.remainders("x" * 5000, False)) == 2


def test_common_ends_keep_misspelt_surnames(spark, monkeypatch):
    names = ["Francisco Brutraflavil", "Paco Brutraflavil", "Francisco Bxutraflavil", "Francisco Brutrafalvix", "Francisco Bru1raflavil", "F. Brutrafavil", "Fabio Brusutaflavil", "Felix Corrnoflavil", "Felix Comoflavil"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {}
    for common in (400, 2):
        monkeypatch.setattr(variants, "COMMON", common)
        got[common] = {tuple(r) for r in variant_pairs(df, "name").collect()}
    assert got[400] == got[2] and ("Francisco Brutraflavil", "Francisco Bxutraflavil") in got[2] and ("Felix Comoflavil", "Felix Corrnoflavil") in got[2]


def test_recurring_misspellings(spark):
    right, misspelt, scan = parse("Jesús Sefomiras"), parse("Jesús Sefomirxas"), parse("Jesús Seforniras")
    assert agreement(right, scan, 40, 30) == 2  # scanning errs the same way each time
    assert agreement(right, misspelt, 40, 4) == agreement(misspelt, right, 4, 40) == 2 and agreement(right, misspelt, 400, 40) == 2
    assert agreement(right, misspelt, 40, 30) == agreement(right, misspelt, 4, 4) == 0
    forms = ["Jesús {}", "{}, Jesús", "Chus {}", "Dr. Jesús {}", "Jesús {} (Autor)", "jesus {}"]
    names = [(f.format(s),) for f in forms for s in ("Sefomiras", "Seforniras")]
    assert len({r.group_id for r in variant_groups(spark.createDataFrame(names, "name string"), "name").collect()}) == 1
