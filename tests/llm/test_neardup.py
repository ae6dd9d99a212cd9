import random

import pytest

from leafmill.llm import neardup

DRAW = random.Random(3)
LEXICON = ["".join(DRAW.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(DRAW.randint(3, 9))) for _ in range(400)]


def grams(text):
    t = " ".join(text.lower().split())
    return {t[i : i + 5] for i in range(len(t) - 4)}


def brute(rows, threshold=0.7):
    texts = [(k, grams(t)) for k, t in rows if k is not None and t and len(" ".join(t.split())) >= 100]
    return {(min(i, j), max(i, j)) for x, (i, a) in enumerate(texts) for j, b in texts[x + 1 :] if i != j and len(a & b) >= threshold * len(a | b)}


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(60):
        words = [DRAW.choice(LEXICON) for _ in range(40)]
        out.append((len(out), " ".join(words)))
        for _ in range(k % 3):
            edited = list(words)
            for _ in range(DRAW.randint(0, 2)):
                edited[DRAW.randrange(40)] = DRAW.choice(LEXICON)
            out.append((len(out), "  ".join(edited).upper()))
    hot = " ".join(DRAW.choice(LEXICON) for _ in range(60))
    out += [(len(out) + k, f"{hot} number {k}") for k in range(40)]
    out += [(900 + k, hot) for k in range(5)]
    out += [(950, None), (951, ""), (952, "short text"), (None, hot), (953, hot * 300), (954, " " + hot.replace(" ", "\n"))]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "chunk_row long, text string, key string, bands int")


@pytest.mark.parametrize("few,block", [(10_000, 512), (16, 512), (2, 8)])
def test_equals_brute_force(spark, rows, monkeypatch, few, block):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = [(r.row_a, r.row_b) for r in neardup.similar_pairs(frame(spark, rows), "chunk_row", "text").collect()]
    assert len(got) == len(set(got))
    # random edits may fall between the bands' sure ranges; the fixture has few such pairs
    want = brute(rows)
    assert set(got) <= want and len(set(got)) >= 0.995 * len(want)


def test_groups(spark, rows):
    got = {r.chunk_row: r for r in neardup.groups(frame(spark, rows), "chunk_row", "text").collect()}
    pairs = brute(rows)
    label = {k: k for k in got}
    for _ in range(len(got)):
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    groups = {}
    for k, r in got.items():
        groups.setdefault(r.group_id, set()).add(label[k])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(label.values()))
    assert set(got) == {k for k, t in rows if k is not None and t and len(" ".join(t.split())) >= 100}


def test_empty_and_bounds(spark):
    assert neardup.similar_pairs(frame(spark, [(1, None)]).where("false"), "chunk_row", "text").count() == 0
    assert neardup.groups(frame(spark, [(1, None)]), "chunk_row", "text").count() == 0
    least = neardup.least_agreeing()
    assert len(least) == neardup.CHECKS // neardup.BATCH and list(least) == sorted(least) and least[-1] < neardup.THRESHOLD * neardup.CHECKS


def test_many_copies_are_listed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    text = "the pump held water near the old gate while the clouds of the valley moved over the quiet river bank "
    rows = [(k, text) for k in range(60)] + [(100 + k, text + "again") for k in range(30)] + [(200, "an entirely different text about the making of glass, iron and stone in several towns of the far north coast")]
    got = [tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()]
    keys = [k for k, _ in rows[:-1]]
    assert sorted(got) == [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    members = neardup._member_blocks(neardup.signed_rows(spark.createDataFrame(rows, "k long, t string"), "k", "t"))
    assert members.agg({"block": "max"}).first()[0] == 7 and max(len(r["keys"]) for r in members.collect()) < 30
