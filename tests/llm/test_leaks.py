import random

from biblioflow.llm import leaks
from biblioflow.llm.words import mended, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(item, doc):
    """Whether some stretch of the item and some stretch of the document of 18 words are within four edits."""
    w = leaks.WINDOW
    return any(distance(item[i : i + w], doc[j : j + w]) <= leaks.EDITS for i in range(len(item) - w + 1) for j in range(len(doc) - w + 1))


def test_words():
    assert words("El <b>Ñú</b> d'Água&amp;ｘ — no_sé…") == ["el", "nu", "d", "agua", "x", "no", "se"] and words(None) == words("") == []
    assert mended("pequeÃ±o â€”YoÂ» città") == "pequeño —Yo» città"


def test_align():
    assert leaks.align("a b c d e".split(), "x a b q d e".split(), 1.0)[:2] == (5, 1)
    assert leaks.align([], ["a"], 1.0)[:2] == (0, 0)


def test_found_and_not_found(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in ((1, 30), (2, 60), (3, 18), (4, 5))] + [(5, None), (6, "")]
    text = {k: t.split() for k, t in items if t}
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, want = [], set()

    def add(w, *found):
        docs.append((len(docs), " ".join(w), "clash"))
        want.update((k, len(docs) - 1) for k in found)

    add(noise(50) + text[1] + noise(50), 1)
    add(noise(9) + text[2][20:45] + noise(9), 2)
    add(text[3], 3)
    edited = text[2][5:40]
    for k in range(4, len(edited), 7):
        edited[k] = "zz"
    add([x.upper() for x in edited], 2)
    add(noise(20) + text[2][:10] + noise(20))
    add(noise(20) + text[4] + noise(9))
    add(text[1][:20] + noise(300) + text[2][:25], 1, 2)
    add(text[2][0:40:2] + noise(4))
    docs += [(90, None, ""), (91, "", ""), (None, items[0][1], ""), (92, "x " * 100_000, "")]
    add_again = spark.createDataFrame(docs, "doc_id long, text string, words string")
    got = leaks.leaked_passages(add_again.unionByName(add_again.where("doc_id = 0")), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert sorted(x.doc_word for x in rows if x.doc_id == 6 and x.item_id == 2) == [320]
    assert {(x.item_id, x.doc_id) for x in rows} == want and all(x.words >= leaks.WINDOW for x in rows)
    for k, i in want:
        assert brute(text[k], docs[i][1].lower().split())


def test_blocks_and_empty(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{n}" for n in range(20))) for k in range(5)], "item_id long, text string")
    docs = items.selectExpr("item_id + 100 as doc_id", "text")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 45)
    assert len(list(leaks._blocks(items, "item_id", "text"))) == 3
    assert sorted((r.item_id, r.doc_id) for r in leaks.leaked_passages(docs, items).collect()) == [(k, k + 100) for k in range(5)]
    assert leaks.leaked_passages(docs, items.where("false")).collect() == [] and leaks.leaked_passages(docs.where("false"), items).collect() == []


def test_prefix_is_enough():
    r = random.Random(1)
    item = leaks.shingles([str(r.randrange(30)) for _ in range(40)])
    rarity = {x: r.randrange(5) for x in item}
    keep = leaks.prefix_positions(item, rarity)
    n = leaks.WINDOW - leaks.SHINGLE + 1
    for start in range(len(item) - n + 1):  # whatever LEAST shingles of a window survive, one of them is looked up
        assert n - len(keep & set(range(start, start + n))) < leaks.LEAST


def test_window_within_a_noisier_copy():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    w, found, rejected = leaks.WINDOW, 0, 0
    for share in (0.2, 0.25, 0.3) * 6:
        item = [r.choice(vocabulary) for _ in range(45)]
        doc = [r.choice(vocabulary) if r.random() < share else x for x in item]
        got = leaks.Index([(7, item)], {}).search(doc)
        if any(distance(item[i : i + w], doc[j : j + w]) <= leaks.SHARE * w for i in range(len(item) - w + 1) for j in range(max(0, i - 4), min(i + 5, len(doc) - w + 1))):
            assert [x[0] for x in got] == [7]
            found += 1
            rejected += leaks.align(item, doc, 1.0)[1] > leaks.SHARE * leaks.align(item, doc, 1.0)[0]
        for _, length, edits, start, end, _ in got:
            assert length >= w and edits <= leaks.SHARE * length and any(distance(item[start:end], doc[j:k]) <= edits for j in range(len(doc)) for k in range(j + end - start - edits, j + end - start + edits + 1))
    assert found and rejected  # the case occurs
    exact = [r.choice(vocabulary) for _ in range(98)]
    for tail, every in ((200, 4), (300, 4), (60, 3)):  # a verbatim run, then a noisy copy of the rest
        item = [r.choice(vocabulary) for _ in range(20 + tail)]
        doc = item[:20] + [r.choice(vocabulary) if k % every == 1 else x for k, x in enumerate(item[20:])]
        assert leaks.Index([(1, item)], {}).search(doc)
    for _ in range(40):  # a verbatim run of 18 anywhere in noise
        item = [r.choice(vocabulary) for _ in range(r.randrange(60, 120))]
        start, share = r.randrange(len(item) - w), r.uniform(0.22, 0.4)
        doc = [x if start <= k < start + w or r.random() > share else r.choice(vocabulary) for k, x in enumerate(item)]
        assert leaks.Index([(1, item)], {}).search(doc)
    noisy = exact[:18] + [r.choice(vocabulary) if k % 10 in (2, 5, 8) else x for k, x in enumerate(exact[18:])]
    assert leaks.Index([(1, exact)], {}).search(noisy) and not leaks.Index([(1, exact)], {}).search(exact[:12])
