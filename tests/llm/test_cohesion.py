import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import cohesion, sentences

MODEL = sentences.train(["One twoo. Three sixx. Four tenn.", "The pump held. Water ran."] * 5)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc .\n\t中", max_size=200), st.integers(5, 40), st.integers(0, 10))
def test_pieces_cover_the_text(text, limit, overlap):
    if len(text.strip()) <= limit:
        return
    got = cohesion.pieces(cohesion.Gaps(text, True, MODEL), limit, overlap)
    overlap = min(overlap, limit - 1)
    assert got[-1][1] == len(text.rstrip()) and got[0][0] == len(text) - len(text.lstrip())
    for (a, b, kind), (c, d, _) in zip(got, got[1:]):
        assert a < c and len(text[a:b].strip()) <= limit and d > b
        # nothing but white space is lost, and the next piece begins at most the overlap before the cut
        assert text[b:c].strip() == "" and (b - c) <= overlap
    assert len(text[got[-1][0] : got[-1][1]].strip()) <= limit


def test_overlap_is_exact_where_it_fits():
    text = "".join(chr(97 + k % 26) for k in range(300))
    got = cohesion.pieces(cohesion.Gaps(text, False, MODEL), 100, 20)
    assert [(a, b) for a, b, _ in got] == [(0, 100), (80, 180), (160, 260), (240, 300)] and got[0][2] == "char"


@pytest.mark.parametrize(
    "text,prose,want",
    [
        ("a" * 8 + "\n \t\n" + "b" * 8, False, "paragraph"),
        ("a" * 8 + "\n \n" + "b" * 8, False, "line"),
        ("aaa aaa\nbbb bbb", False, "line"),
        ("One two. Three six.", True, "sentence"),
        ("One two. Three six.", False, "word"),
        ("aaaaaa bbbbbb cc", True, "word"),
        ("a" * 30, True, "none"),
        ("  " + "a" * 10 + "\n\n" + "b" * 3 + "  ", False, "paragraph"),
    ],
)
def test_division(text, prose, want):
    model = sentences.train(["One two. Three six. Four ten. Five two."] * 4)
    assert cohesion.Gaps(text, prose, model).division(10) == want


def test_the_topic_changes_at_the_cut():
    a, b = "The pump valve fed the pump. " * 4, "Clouds and rain cooled clouds. " * 4
    text = (a + b).strip()
    model = sentences.train(["The pump valve fed the pump. Clouds and rain cooled clouds."] * 3)
    got = cohesion.pieces(cohesion.Gaps(text, True, model), len(a) + 40, 0)
    assert text[: got[0][1]].strip() == a.strip()


def test_a_deep_valley_beats_a_flat_paragraph_break():
    pump, rain = "The pump valve fed the pump again. ", "Clouds and rain cooled the clouds below. "
    model = sentences.train([pump + rain] * 3)
    first = pump * 6
    text = first + rain * 3 + "\n\n" + rain * 8
    got = cohesion.pieces(cohesion.Gaps(text, True, model), len(first) + 3 * len(rain) + 20, 0)
    assert text[: got[0][1]].strip() == first.strip() and got[0][2] == "sentence"
    # where the valleys are alike, the paragraph break is taken
    text = pump * 6 + "\n\n" + pump * 6
    got = cohesion.pieces(cohesion.Gaps(text, True, model), 8 * len(pump), 0)
    assert got[0][2] == "paragraph"


def depths_one_by_one(text, places, chosen):
    """The same valleys, gap by gap from word counts."""
    bounds = [0, *(places[k] for k in chosen), len(text)]
    bags = [Counter(m[0].lower() for m in cohesion.WORD.finditer(text) if a <= m.start() < b) for a, b in zip(bounds, bounds[1:])]
    similar = []
    for k in range(len(chosen)):
        left, right = sum(bags[max(0, k + 1 - cohesion.SIDE) : k + 1], Counter()), sum(bags[k + 1 : k + 1 + cohesion.SIDE], Counter())
        norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
        similar.append(sum(v * right[w] for w, v in left.items()) / norm if norm else 0.0)
    out = []
    for k, s in enumerate(similar):
        a = b = k
        while a > 0 and similar[a - 1] >= similar[a]:
            a -= 1
        while b + 1 < len(similar) and similar[b + 1] >= similar[b]:
            b += 1
        out.append(max(0.0, similar[a] + similar[b] - 2 * s))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["pump", "valve", "rain", "Rain", "the", "cloud.", "wind.", "\n", "\n\n", "a1"]), max_size=150))
def test_depths(words):
    text = " ".join(words)
    gaps = cohesion.Gaps(text, True, MODEL)
    chosen, got = cohesion.depths(text, gaps.places, gaps.levels)
    assert all(k in chosen for k, v in enumerate(gaps.levels) if v > 1)
    assert got == pytest.approx(depths_one_by_one(text, gaps.places, chosen.tolist()))


def test_a_long_text_is_cut_in_linear_time():
    text = " ".join(f"w{k:x}" + ("." if k % 12 == 11 else "") for k in range(150_000))
    began = time.process_time()
    assert len(cohesion.pieces(cohesion.Gaps(text, True, MODEL), 1200, 100)) > 700
    assert time.process_time() - began < 8


def test_tables(spark):
    limits = spark.createDataFrame([("block", "text", 11, 2), ("block", "code", 10, None), ("chunk", "text", 5, 0)], "target string, kind string, max_chars int, overlap_chars int")
    rows = [(1, " Text ", "One twoo. Three sixx.", 0), (2, "code", "a" * 25, 0), (3, "title", "x" * 99, 0), (4, None, "x" * 99, 0), (5, "text", None, 0), (6, "text", "  short      ", 0), (1, "text", "One twoo. Three sixx.", 0)]
    df = spark.createDataFrame(rows, "block_row long, block_type string, text string, size int")
    got = cohesion.split_oversized(cohesion.oversized(df, "block", "block_row", "block_type", "text", limits), MODEL).collect()
    assert {(r.row_id, r.boundary) for r in got} == {(1, "sentence"), (2, "none")}
    assert sum(r.row_id == 2 for r in got) == 3 and all(r.size <= 11 for r in got)
    assert sum(r.row_id == 1 and r.piece_no == 0 for r in got) == 2
    assert cohesion.split_oversized(cohesion.oversized(df.where("false"), "block", "block_row", "block_type", "text", limits), MODEL).count() == 0
    short = cohesion.divisions(cohesion.oversized(df, "block", "block_row", "block_type", "text", limits), MODEL).collect()
    assert {(r.row_id, r.boundary) for r in short} == {(1, "sentence"), (2, "none")} and len(short) == 3
