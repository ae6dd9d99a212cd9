import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import encode, mixing


@settings(max_examples=100, deadline=None)
@given(st.floats(0, 1000), st.lists(st.tuples(st.floats(0, 1), st.floats(0, 300)), max_size=6))
def test_water(budget, children):
    weights, most = [w for w, _ in children], [m for _, m in children]
    parts = mixing.water(budget, weights, most)
    room = sum(m for w, m in children if w > 0)
    assert all(0 <= p <= m + 1e-6 for p, m in zip(parts, most))
    assert abs(sum(parts) - min(budget, room)) < 1e-6 * (1 + budget) or not any(w > 0 for w in weights)


def test_shortage_goes_to_siblings_first():
    leaves = {("x", "en", "short"): (0.3, 10.0), ("x", "en", "near"): (0.2, 1e9), ("y", "en", "far"): (0.5, 1e9)}
    got = mixing.budgets(leaves, 100.0)
    assert got["x", "en", "short"] == 10 and abs(got["x", "en", "near"] - 40) < 1e-9 and abs(got["y", "en", "far"] - 50) < 1e-9
    leaves["x", "en", "near"] = (0.2, 25.0)
    got = mixing.budgets(leaves, 100.0)
    assert got["x", "en", "near"] == 25 and abs(got["y", "en", "far"] - 65) < 1e-9


@pytest.fixture
def sized(spark):
    rows = [(k, "d", "en" if k % 3 else "de", ("a", "b", "c", None)[k % 4], 10 + k % 7) for k in range(4000)] + [(9000, "d", "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")


def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("cut", [4096, 50])
def test_mixture(spark, sized, monkeypatch, cut):
    monkeypatch.setattr(mixing, "SLICE", cut)
    total = 24_000
    mix = mixing.mixture(sized, targets(spark), total)
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.tokens > 0 for r in rows)
    assert max(r.uses for r in rows if r.source == "a") == 1 and max(r.uses for r in rows if r.source == "b") <= 3
    got = {r.source: r for r in mixing.shares(sized, mix, targets(spark)).collect()}
    assert abs(got["a"].share - 0.5) < 0.01 and abs(got["b"].share - 0.3) < 0.01 and abs(got["c"].share - 0.2) < 0.01
    assert got["none"].share == 0 and got["none"].records == 0
    assert abs(sum(r.tokens * r.uses for r in rows) - total) < 200
    assert {(r.doc_id, r.uses) for r in mixing.mixture(sized, targets(spark), total).collect()} == {(r.doc_id, r.uses) for r in rows}


def test_a_source_that_is_short(spark, sized):
    mix = mixing.mixture(sized, targets(spark), 60_000)
    got = {r.source: r for r in mixing.shares(sized, mix, targets(spark)).collect()}
    assert got["a"].used_tokens == got["a"].tokens and got["a"].share < 0.5 and got["b"].share > 0.3


@pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary file")
def test_from_documents(spark):
    rows = [(1, "one two three", "A a", "EN-us", 5), (2, None, None, None, None), (3, "", "b", None, 0), (None, "four", "B ", "ru", 1), (5, "same", "a-a", "en", 1), (5, "same", "a-a", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    got = mixing.sized(df).collect()
    assert sorted((r.source or "", r.lang, r.tokens) for r in got) == [("", "un", 0), ("a_a", "en", 1), ("a_a", "en", 1), ("a_a", "en", 3), ("b", "ru", 1), ("b", "un", 0)] or sorted((r.source or "", r.tokens) for r in got) == [("", 0), ("a_a", 1), ("a_a", 1), ("a_a", 3), ("b", 0), ("b", 1)]
    assert mixing.mixture(mixing.sized(df.where("false")), targets(spark)).count() == 0
