import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import packing, sentences


def fewest(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = len(sizes)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for i in range(len(free)):
            if free[i] >= sizes[k]:
                go(k + 1, [*free[:i], free[i] - sizes[k], *free[i + 1 :]])
        go(k + 1, [*free, capacity - sizes[k]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=9))
def test_near_the_fewest(sizes):
    bins = packing.pack(sizes, 100)
    assert sorted(itertools.chain(*bins)) == list(range(len(sizes)))
    assert all(0 < sum(sizes[k] for k in b) <= 100 for b in bins)
    if sizes:
        assert len(bins) <= fewest(sizes, 100) + 1


def test_exchange_empties_a_bin():
    # best fit needs three bins here, exchanging needs two
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert sum(sizes) == 180
    assert len(packing.pack(sizes, 90)) == 2


def test_all_underfull_bins_take_part():
    draw = random.Random(5)
    sizes = [draw.randint(250, 450) for _ in range(3000)]
    bins = packing.pack(sizes, 1000)
    assert sorted(itertools.chain(*bins)) == list(range(3000)) and all(sum(sizes[k] for k in b) <= 1000 for b in bins)
    assert len(packing.best_fit(sizes, 1000)) > 1170 and len(bins) <= 1125


def test_search_goes_on_from_given_bins():
    sizes = [60, 40, 60, 40, 50]
    assert len(packing.pack(sizes, 100, [[0], [1], [2], [3], [4]])) == 3
    assert packing.pack(sizes, 100, [[0, 1], [2, 3], [4]]) == [[0, 1], [2, 3], [4]]


def table(spark, rows):
    return spark.createDataFrame(rows, "document_id string, block_row long, block_order int, text string, shard string, bin int")


def test_documents(spark):
    cap, model = 50, sentences.train([])
    rows = [("d", k, k % 40, "x" * (5 + k * 7 % 30), "clash", 1) for k in range(120)]
    rows += [("d", 900, 3, "word " * 40, None, None), (None, 901, None, "  lone  ", None, None), ("e", 902, 1, " ", None, None), ("e", 903, 1, None, None, None), ("f", 904, 1, "dup", None, None), ("f", 904, 1, "dup", None, None)]
    before = packing.SHARD
    packing.SHARD = 16
    try:
        bins = packing.packed(packing.items_of(table(spark, rows), cap, model), cap)
        got = packing.chunks(bins, cap).collect()
    finally:
        packing.SHARD = before
    by = {}
    for r in got:
        by.setdefault(r.document_id, []).append(r)
        assert 0 < r.size <= cap and r.free == cap - r.size and len(r.block_rows) == r["items"]
    assert set(by) == {"d", None, "f"}
    assert by[None][0].size == 4 and sorted(by["f"][0].block_rows) == [904, 904]
    placed = [b for r in by["d"] for b in r.block_rows]
    assert sorted(b for b in placed if b < 900) == list(range(120)) and placed.count(900) >= 4
    order = {k: k % 40 for k in range(120)} | {900: 3}
    assert all([order[b] for b in r.block_rows] == sorted(order[b] for b in r.block_rows) for r in by["d"])
    total = sum(r.size for r in by["d"])
    assert len(by["d"]) <= -(-total // cap) + 2
    s = {r.document_id: r for r in packing.summary(packing.chunks(bins, cap), cap).collect()}
    assert s["d"].chunks == len(by["d"]) and s["d"].least_chunks == -(-total // cap)


def test_a_hot_document_in_rounds(spark):
    """Blocks that leave room in nearly every bin, in many groups; copies of a row are items of their own."""
    draw = random.Random(3)
    rows = [("d", k // 2, k, "x" * draw.randint(20, 36), None, 0) for k in range(600)] + [(None, 1000 + k, k, "y" * draw.randint(20, 36), None, 0) for k in range(200)]
    before, packing.SHARD = packing.SHARD, 64
    try:
        got = packing.chunks(packing.packed(packing.items_of(table(spark, rows), 100, sentences.train([])), 100), 100).collect()
    finally:
        packing.SHARD = before
    assert sorted(b for r in got for b in r.block_rows) == sorted(r[1] for r in rows) and all(r.size <= 100 for r in got)
    for document in ("d", None):
        sizes = [len(r[3]) for r in rows if r[0] == document]
        alone = len(packing.pack(sizes, 100))
        assert sum(r.document_id == document for r in got) <= alone * 1.02 + 1


def test_empty(spark):
    items = packing.items_of(table(spark, []), 50, sentences.train([]))
    assert packing.chunks(packing.packed(items, 50), 50).count() == 0
