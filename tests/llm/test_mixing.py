import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biblioflow.llm import mixing

# Weights so small that their ratios are rounding noise can't be held to proportions.
source = st.tuples(st.one_of(st.just(0.0), st.floats(1e-9, 1)), st.integers(0, 6), st.integers(0, 10_000))


@settings(max_examples=200, deadline=None)
@given(st.lists(source, max_size=8), st.one_of(st.none(), st.floats(1, 50_000)))
def test_fill(rows, total):
    parts = mixing.fill([(str(k), w, m) for k, (w, m, _) in enumerate(rows)], {str(k): n for k, (_, _, n) in enumerate(rows)}, total)
    size = sum(n for _, _, n in rows) if total is None else total
    assert all(-1e-6 <= p.wanted <= p.most * p.size + 1e-6 for p in parts)
    usable = [p for p in parts if p.target > 0 and p.most * p.size > 0]
    assert sum(p.wanted for p in parts) == pytest.approx(min(size, sum(p.most * p.size for p in usable)), rel=1e-6, abs=1e-6)
    free = [p for p in usable if p.wanted < p.most * p.size - 1e-6]
    for p in free:  # those that aren't full share in proportion to their weights
        assert p.wanted / p.target == pytest.approx(free[0].wanted / free[0].target, rel=1e-6)
        assert all(q.wanted / q.target <= p.wanted / p.target * (1 + 1e-6) + 1e-6 for q in usable)


def test_mix(spark):
    rows = [(k, f"palabra número {k} de muchas", " Big" if k % 3 else "BIG ") for k in range(300)] + [(1000 + k, "corta", "small") for k in range(10)]
    rows += [(2000, None, "small"), (2001, "", "small"), (2002, "x", None), (2003, "x", "other"), (2004, "larga " * 5000, "Long-One")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as copy")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("long_one", 0.3, 1), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    args = docs, targets, "doc_id", "text", "source"
    got = mixing.mix(*args).collect()
    assert sorted(got) == sorted(mixing.mix(*args).collect()) and len(got) == len({(r.doc_id, r.copy) for r in got})
    copies = {}
    for r in got:
        copies.setdefault(r.source, {}).setdefault(r.doc_id, []).append(r.copy)
    assert set(copies) <= {"big", "small", "long_one"} and all(max(c) <= {"big": 1, "small": 3, "long_one": 1}[s] for s, d in copies.items() for c in d.values())
    assert len(copies["small"]) == 12 and all(c == [1, 2, 3] or sorted(c) == [1, 2, 3] for c in copies["small"].values())
    shares = {r.source: r for r in mixing.shares(*args).collect()}
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1) and shares["gone"].mixed_tokens == 0 and shares["small"].mixed_tokens == 3 * shares["small"].tokens
    tokens = {r.doc_id: r.tokens for r in mixing.with_tokens(docs).collect()}
    for s, d in copies.items():
        assert sum(tokens[k] * len(c) for k, c in d.items()) == shares[s].mixed_tokens
    assert mixing.mix(docs, targets.where("false"), *args[2:]).collect() == [] and mixing.mix(docs.where("false"), *args[1:]).collect() == []
    assert mixing.mix(*args, seed=2, total=500).count() < len(got)


def test_fraction_of_few_documents(spark):
    docs = spark.createDataFrame([(k, "una dos tres", "a") for k in range(3)] + [(10 + k, "una dos tres", "b") for k in range(40)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    one = mixing.with_tokens(docs).first().tokens
    shares = {r.source: r for r in mixing.shares(docs, targets, "doc_id", "text", "source", total=4 * one).collect()}
    assert shares["a"].mixed_tokens == shares["b"].mixed_tokens == 2 * one and mixing.mix(docs, targets, "doc_id", "text", "source", total=4 * one).count() == 4


def test_tokens_round_trip(spark):
    t = mixing._tokenizer(mixing.TOKENIZER)
    for x in ("El faro <|endoftext|> ñandú", "日本", "a  b\n"):
        assert t.decode(t.encode(x, add_special_tokens=False).ids) == x
