import random

import pytest

from leafmill.llm import truncation


@pytest.mark.parametrize(
    "text,state",
    [
        ("The pump held.", "closed"), ("The pump held", "open"), ("The pu", "open"), ("The pump [truncated]", "mark"), ("The pump… Read on", "mark"), ("The pump ra...", "open"), ("Held.\n\nTo be continued…", "open"),
        ("| a | b |\n| 1 | 2 |", "closed"), ("| a | b |\n| 1 |", "broken"), ("| a | b |\n| 1 | tw", "broken"), ("It ran.\n\n| a | b |", "broken"), ("k: 1 | v: 2\nk: 3", "broken"), ("k: 1 | v: 2\nk: 3 | v: 4", "open"), ("```\nx = 1\n```", "closed"), ("```\nx = 1", "broken"),
        ("She said: “It held.", "open"), ("She said: “It held.”", "closed"), ("It ran. “Did it hold?”", "open"), ("It ran. “Did it hold?” asked M. Lum.", "closed"), ("It ran (" + "very " * 900 + "well.", "open"),
        ("- one item\n- two items", "open"), ("为什么？他来了", "open"), ("他来了。", "closed"), ("See the Fig.", "open"), ("At 7 p.m.", "closed"), ("", "blank"), (" \n ​", "blank"), ("x�", "mark"), ("  The pump held.  \n", "closed"), (".", "closed"), ("|", "broken"),
    ],
)
def test_ending(text, state):
    assert truncation.ending(text)[0] == state


def test_a_remark_of_any_length_keeps_its_class():
    for size in (1, 400):
        assert truncation.ending("It ran. “Did it hold" + " and hold" * size + "?”")[3] == ["cremark"]


def frame(spark, rows):
    return spark.createDataFrame([(k, s, t, 5, "x") for k, (s, t) in enumerate(rows)], "doc_id long, source string, text string, chars int, state string")


WORDS = "pump valve water gate tower filter sensor cable panel bridge river cloud wind stone iron glass".split()


def corpus(times=1, seed=4):
    """(source, text, cut): whole texts with several natural ends without a mark, texts cut at 300 characters, and texts cut anywhere."""
    draw = random.Random(seed)

    def sentence():
        return " ".join(["The", *(draw.choice(WORDS) for _ in range(draw.randint(5, 12))), "held"]) + "."

    def body(n):
        return " ".join(sentence() for _ in range(n))

    out = []
    for k in range(400 * times):
        ends = ("", "", f"\n— M. Nimdric, Unit {k}", f"\nTotal: {k}.5 kg", f"\n- {draw.choice(WORDS)} {draw.choice(WORDS)}", f"\nReviewed 20{k % 90 + 10}-02-16")
        out.append(("whole", body(draw.randint(1, 9)) + draw.choice(ends), False))
    for _ in range(40 * times):
        out.append(("limited", body(20)[:300], True))
        out.append(("limited", body(2), False))
    for _ in range(20 * times):
        text = body(6)
        out.append(("whole", text[: draw.randint(60, 250)].rstrip(" .") + "x", True))
    return [(s, t, c and not t.rstrip().endswith(".")) for s, t, c in out]


@pytest.mark.parametrize("times", [1, 3])
def test_limits_and_endings(spark, times):
    rows = corpus(times)
    inspected = truncation.inspect(frame(spark, [r[:2] for r in rows]))
    limits = {(r.source, r.unit, r["limit"]) for r in truncation.spikes(inspected).collect()}
    assert ("limited", "char", 300) in limits and all(s == "limited" for s, _, _ in limits)
    got = {r.doc_id: r for r in truncation.truncated(inspected).collect()}
    for k, (s, t, _) in enumerate(rows):
        if s == "limited" and len(t) == 300:
            assert (k in got) == (not t.rstrip().endswith("."))
    assert all(r.unit == "char" and r["limit"] == 300 and r["at"] > 20 > r.expected for r in got.values() if r.reason.startswith("limit"))
    want = {k for k, r in enumerate(rows) if r[2]}
    assert len(want & got.keys()) >= 0.95 * len(want) and len(want & got.keys()) >= 0.95 * len(got)
    rates = {r.source: r for r in truncation.rates(inspected).collect()}
    assert rates["limited"].documents == 80 * times and rates["limited"].cut == rates["limited"].cut_at_limit > 30 * times


def test_spikes_decide(spark, monkeypatch):
    rows = corpus()
    inspected = truncation.inspect(frame(spark, [r[:2] for r in rows]))
    spikes = truncation.spikes
    monkeypatch.setattr(truncation, "spikes", lambda r: spikes(r).where("false"))
    assert truncation.truncated(inspected).count() == 0


def test_copies_make_no_spike(spark):
    rows = [("copies", "The same text stops in the mid")] * 50 + [("other", f"Text {k} ends well." + " It ran." * k) for k in range(40)]
    inspected = truncation.inspect(frame(spark, rows))
    assert truncation.spikes(inspected).count() == 0 and truncation.truncated(inspected).count() == 0


def test_sources_nulls_and_empty(spark):
    rows = [("a", None), ("a", ""), (None, " \n"), (None, "It is whole."), (" My-Source ", "x [truncated]"), (None, "k: 1 | v: 2\nk: 3")]
    inspected = truncation.inspect(frame(spark, rows))
    got = {r.doc_id: r for r in truncation.truncated(inspected).collect()}
    assert set(got) == {4, 5} and got[4].source == "my_source" and got[5].reason == "broken record" and not got[4].at_limit
    rates = {r.source: r for r in truncation.rates(inspected).collect()}
    assert rates[None].documents == 3 and rates[None].cut == 1 and rates["a"].cut == 0 and rates["my_source"].rate == 1.0
    none = truncation.inspect(frame(spark, rows).where("false"))
    assert truncation.truncated(none).count() == 0 and truncation.rates(none).count() == 0


def test_null_sources_are_held_against_all_limits(spark):
    rows = [r[:2] for r in corpus()] + [(None, ("The pump valve held near the gate and " * 20)[:299] + "v")]
    got = {r.doc_id: r for r in truncation.truncated(truncation.inspect(frame(spark, rows))).collect()}
    assert got[len(rows) - 1].at_limit


def test_learning():
    assert truncation.learn([]) is None and truncation.learn([("a\x1fb", 1, 3)]) is None
    weights, bias = truncation.learn([("a\x1fb", 1, 30), ("a\x1fc", 0, 10), ("d\x1fc", 0, 300), ("d\x1fe", 0, 300)])
    score = lambda f: weights[truncation._hashed(f)].sum() + bias
    assert score("a\x1fb") > 0 > score("d\x1fe")
