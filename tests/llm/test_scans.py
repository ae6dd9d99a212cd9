import random
from collections import Counter

import pytest

from leafmill.llm import scans

WORDS = "the a valve pump held no water and opened in clean-room panel near of old river section design was closed again".split()


def test_automaton_finds_all_words_within_the_distance():
    vocabulary = scans.Vocabulary(WORDS)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for text in ("va1ve", "purnp", "", "thee", "wter", "closedd"):
        for k in (1, 2):
            assert sorted(vocabulary.within(text, k)) == sorted((distance(text, w), w) for w in set(WORDS) if distance(text, w) <= k)


@pytest.mark.parametrize("seen,meant", [("va1ve", "valve"), ("purnp", "pump"), ("0pened", "opened"), ("secti0n", "section"), ("paricl", None), ("pariel", "panel"), ("o1d", "old"), ("Velmora", None), ("x" * 500, None)])
def test_reading(seen, meant):
    assert scans.Vocabulary(WORDS).reading(seen.lower(), seen[:1].isupper()) == meant


def test_words_that_go_on():
    vocabulary = scans.Vocabulary(WORDS)
    assert vocabulary.goes_on("val") and not vocabulary.goes_on("clean") and not vocabulary.goes_on("valve") and not vocabulary.goes_on("") and not vocabulary.goes_on("zz")


PAGES = [
    ["On Valve Design", "", "The va1ve held no water and the pump op-", "ened in the clean-", "room. The panel", "12.5", "- 41 -"],
    ["A. Velmora", "", "near the river was closed", "again.", "", "The pump held.", "- 42 -"],
    ["0n Valve Design", "The old section of the pump was near Vel-", "mora. The end", "- 43 -"],
    ["A. Velm0ra", "of the river near Velmora was closed.", "- 44 -"],
]


def blocks(spark, pages):
    rows = [(10 + k, "d", k + 1, k, "\n".join(p), "clash") for k, p in enumerate(pages)]
    rows += [(90, "d", 2, 1, "\n".join(pages[1]), "again"), (91, "d", 2, 9, None, None), (92, "d", None, None, "1oose panel", None), (93, None, 1, 1, "the va1ve", None), (None, "d", 1, 3, "the va1ve", None), (94, "d", 3, 12, "  ", None)]
    return spark.createDataFrame(rows, "block_row long, document_id string, page_number int, block_order int, text string, window string")


def test_defects(spark):
    got = {(r.block_row, r.line_no, r.kind) for r in scans.defects(blocks(spark, PAGES), WORDS).collect()}
    assert {(10, 0, "header"), (11, 0, "header"), (12, 0, "header"), (13, 0, "header"), (90, 0, "header")} <= got
    assert {(10, 6, "page_number"), (11, 6, "page_number"), (12, 3, "page_number"), (13, 2, "page_number"), (90, 6, "page_number")} <= got
    assert {x for x in got if x[2] == "hyphen"} == {(10, 2, "hyphen"), (12, 1, "hyphen")}
    assert {x for x in got if x[2] == "misread"} == {(10, 2, "misread"), (93, 0, "misread")}
    assert scans.defects(blocks(spark, PAGES).where("false"), WORDS).count() == 0
    assert all(r.kind != "misread" for r in scans.defects(blocks(spark, PAGES), []).collect())


def test_windows_do_not_change_the_result(spark, monkeypatch):
    draw = random.Random(2)
    pages = [[PAGES[k % 2][0], *[" ".join(draw.choice(WORDS) for _ in range(8)) for _ in range(6)], "the va1ve op-", f"ened {draw.random()}", f"- {40 + k} -"] for k in range(24)]
    whole = {tuple(r) for r in scans.defects(blocks(spark, pages), WORDS).collect()}
    monkeypatch.setattr(scans, "PAGES", 6)
    monkeypatch.setattr(scans, "MARGIN", 3)
    assert {tuple(r) for r in scans.defects(blocks(spark, pages), WORDS).collect()} == whole


def test_paragraphs(spark):
    got = [r.text for r in scans.paragraphs(blocks(spark, PAGES).where("document_id = 'd' and page_number is not null and block_row is not null"), WORDS).orderBy("paragraph_no").collect()]
    assert got[0] == "The valve held no water and the pump opened in the clean-room. The panel"
    assert "12.5" in got and "The pump held." in " ".join(got)
    assert any("near Velmora. The end of the river" in t for t in got)


def test_vocabulary_bound(spark, monkeypatch):
    words = spark.createDataFrame([("A",), ("b",), (None,), ("b",)], "word string")
    assert sorted(scans.read_vocabulary(words)) == ["a", "b"]
    monkeypatch.setattr(scans, "VOCABULARY_WORDS", 1)
    with pytest.raises(ValueError):
        scans.read_vocabulary(words)


def test_readings_of_equal_cost_are_ranked_by_the_words_beside(spark):
    words = ["the", "hat", "bat", "wool", "flew", "was", "away", "of", "a"]
    found = scans.Vocabulary(words).candidates("?at", False)
    assert scans.Vocabulary(words).candidates("6at", False)[0][1] == "bat" and {w for c, w in found if c == found[0][0]} == {"bat", "hat"}
    rows = [(k, f"d{k}", 1, 0, "The wool hat was of wool.\nA bat flew away.") for k in range(3)] + [(9, "x", 1, 0, "The wool #at was of wool.\nA #at flew away.")]
    blocks = spark.createDataFrame(rows, "block_row long, document_id string, page_number int, block_order int, text string")
    got = {r.document_id: r.text for r in scans.paragraphs(blocks, words).collect()}
    assert got["x"] == "The wool hat was of wool. A bat flew away."


def test_the_automatons_readings_are_all_kept():
    vocabulary = scans.Vocabulary(["house", "mouse", "holes", "the", "ran"])  # pairs are of words of the vocabulary
    assert {w for _, w in vocabulary.candidates("xouye", False)} == {"house", "mouse"} and vocabulary.reading("xouye", False) is None
    beside = scans.Beside({("the", "mouse"): 4, ("mouse", "ran"): 2}, Counter())
    assert vocabulary.reading("xouye", False, beside, "the", "ran") == "mouse"
    assert vocabulary.reading("xouye", False, beside, "the", "x") is None and vocabulary.reading("xouye", True, beside, "the", "ran") is None
    assert vocabulary.reading("nouse", False, beside, "the", "ran") == "mouse" and vocabulary.reading("nouse", False) == "house"


def test_headers_recur_across_windows(spark, monkeypatch):
    draw = random.Random(5)
    body = lambda: [" ".join(draw.choice(WORDS) for _ in range(8)) for _ in range(5)]
    long = "The Annual Report Of The Old River Section And Of All Its Valves And Pumps In The Clean-Room Near The Water"
    pages = [[*(["On Valves And Rivers"] if k in (2, 60) else []), *([long] if k in (20, 40, 55) else []), *body()] for k in range(64)]
    monkeypatch.setattr(scans, "PAGES", 8)
    monkeypatch.setattr(scans, "MARGIN", 1)
    rows = [(k, "d", k - 30, k, "\n".join(p)) for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "block_row long, document_id string, page_number int, block_order int, text string")
    got = {(r.block_row, r.line_no) for r in scans.defects(df, WORDS).collect() if r.kind == "header"}
    assert {(2, 0), (60, 0), (20, 0), (40, 0), (55, 0)} <= got


def test_headers_of_several_lines(spark):
    draw = random.Random(6)
    pages = [["On Valves", "Second Part", "Third Line Here", "Fourth Line Here", *[" ".join(draw.choice(WORDS) for _ in range(8)) for _ in range(9)]] for _ in range(5)]
    rows = [(k, "d", k, k, "\n".join(p)) for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "block_row long, document_id string, page_number int, block_order int, text string")
    got = {(r.block_row, r.line_no) for r in scans.defects(df, WORDS).collect() if r.kind == "header"}
    assert got == {(k, n) for k in range(5) for n in range(4)}


def test_pages_of_any_number(spark):
    rows = [(k, "d", n, 0, f"{w} va1ve") for k, (n, w) in enumerate([(-200, "old"), (-1, "near the"), (0, "held no"), (None, "pump and"), (7, "river section")])]
    df = spark.createDataFrame(rows, "block_row long, document_id string, page_number int, block_order int, text string")
    assert {(r.block_row, r.kind) for r in scans.defects(df, WORDS).collect()} == {(k, "misread") for k in range(5)}
    assert " ".join(r.text for r in scans.paragraphs(df, WORDS).collect()).count(" valve") == 5


def test_hyphens_after_names(spark):
    rows = [(k, f"d{k}", 1, 0, f"the Velmora-mini pump {k} held no water") for k in range(3)] + [(9, "x", 1, 0, "the Tarlowe-\nmini pump and Tar-\nlen held")]
    df = spark.createDataFrame(rows, "block_row long, document_id string, page_number int, block_order int, text string")
    assert scans.read_suffixes(df) == ["mini"]
    assert {(r.block_row, r.line_no) for r in scans.defects(df, WORDS).collect() if r.kind == "hyphen"} == {(9, 1)}


def test_no_pair_and_no_suffix_is_cut_off(spark, monkeypatch):
    words = ["the", "hat", "bat", "wool", "flew", "was", "away", "of", "a", "mini"]
    rows = [(k, f"d{k}", 1, 0, "The wool hat was of wool.\nA bat flew away.\nThe Velmora-mini hat") for k in range(3)]
    rows += [(9, "x", 1, 0, "The wool #at was of wool.\nA #at flew away.\nThe Tarlowe-\nmini hat"), (10, None, 1, 0, "wool #at was"), (11, "x", None, 0, "a #at flew")]
    df = spark.createDataFrame(rows, "block_row long, document_id string, page_number int, block_order int, text string")

    def found():
        texts = sorted((str(r.document_id), r.first_page, r.text) for r in scans.paragraphs(df, words).collect())
        return texts, {tuple(r) for r in scans.defects(df, words).collect()}

    whole = found()
    assert ("x", 1, "The wool hat was of wool. A bat flew away. The Tarlowe-mini hat") in whole[0] and ("None", 1, "wool hat was") in whole[0] and ("x", 0, "a bat flew") in whole[0]
    monkeypatch.setattr(scans, "PAIRS_SENT", 1)
    assert found() == whole and scans.read_pairs(df, words) is None
    monkeypatch.setattr(scans, "SUFFIXES_SENT", 0)
    assert found() == whole and scans.read_suffixes(df) is None


def test_pairs_are_looked_up_exactly(spark):
    df = spark.createDataFrame([("d", "old valve held"), ("e", "Old valve, old valve")], "document_id string, text string")
    pairs = scans.read_pairs(df, ["valve", "old", "held", "old", ""])
    assert {(a, b): pairs.get((a, b), 0) for a in ("old", "valve", "held", "x") for b in ("old", "valve", "held", "x") if pairs.get((a, b), 0)} == {("old", "valve"): 2, ("valve", "held"): 1, ("valve", "old"): 1}
    assert len(pairs) == 3
