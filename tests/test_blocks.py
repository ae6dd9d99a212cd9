from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leafmill.operators import blocks

ITEM = "document_id string, seq int, kind string, text string, page_no int, item_level int, caption string, table_md string"
SLOW = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def items(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], ITEM)


def test_stack_and_carry(spark):
    levels = [(2, "x"), (3, "y"), (3, "z"), (1, "a"), (2, "b"), (4, "c"), (3, "d"), (1, "e")]
    rows = [("d", 0, "text", "before", 1)]
    for k, (level, name) in enumerate(levels):
        rows.append(("d", 2 * k + 1, "heading", name, 1 + k // 3, level))
        rows.append(("d", 2 * k + 2, "text", f"under {name}", 1 + k // 3))
    rows.append(("d", 99, "title", "T", 4))
    rows.append(("d", 100, "text", "last", 4))
    got = {r.text: r for r in blocks.extract(items(spark, rows)).collect()}
    assert got["before"].section_id is None and got["before"].section_path == []
    assert ["/".join(got[n].section_path) for _, n in levels] == ["x", "x/y", "x/z", "a", "a/b", "a/b/c", "a/b/d", "e"]
    assert got["under d"].section_path == ["a", "b", "d"] and got["under d"].section_id == 7
    assert got["T"].section_path == [] and got["T"].section_id is None
    assert got["last"].section_path == ["e"]
    old = {r.text: "/".join(r.section_path) for r in blocks.paths_v1(items(spark, rows)).collect()}
    assert old["y"] == "x/y" and old["z"] == "x/y/z"


def test_what_becomes_a_block(spark):
    rows = [
        ("d", 0, "text", "lost", None),
        ("d", 1, "text", "  ", 1),
        ("d", 2, "figure", None, 1, None, "  "),
        ("d", 3, "figure", None, 1, None, "A cap"),
        ("d", 4, "MyListThing", " entry ", 1),
        ("d", 5, "unknown", "x", 1),
        ("d", 6, "table", "plain", 2, None, None, "| a |"),
    ]
    got = blocks.extract(items(spark, rows)).orderBy("block_order").collect()
    assert [(r.block_order, r.block_type, r.text, r.atomic) for r in got] == [
        (0, "figure", "[Figure]", True), (1, "figure", "A cap", True), (2, "list_item", "entry", None), (3, "table", "| a |", True),
    ]


def fold(rows):
    """The stack as a plain loop."""
    stack, out = [], []
    for level, name in rows:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, name))
        out.append([n for _, n in stack])
    return out


def fold_v1(rows):
    """The older rule as a plain loop."""
    path, out = [], []
    for level, name in rows:
        path = path[: max(level, 1) - 1] + [name]
        out.append(path)
    return out


@settings(SLOW, max_examples=5)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 5, 40]), min_size=1, max_size=60))
def test_slices_equal_one_loop(spark, levels):
    """Levels of any depth, in slices of slices."""
    named = [(v, f"h{k}") for k, v in enumerate(levels)]
    rows = [("d", k, "heading", n, 1, v) for k, (v, n) in enumerate(named)]
    before = blocks.SLICE
    blocks.SLICE = 4
    try:
        got = blocks.extract(items(spark, rows)).orderBy("block_order").collect()
        old = blocks.paths_v1(items(spark, rows)).orderBy("seq").collect()
    finally:
        blocks.SLICE = before
    assert [r.section_path for r in got] == fold(named)
    assert [r.section_path for r in old] == fold_v1(named)
    assert [r.section_id for r in got] == list(range(1, len(named) + 1)) and [r.block_order for r in got] == list(range(len(named)))


def test_pages_and_features(spark):
    rows = [("d", 0, "heading", "1 A", 1), ("d", 1, "figure", None, 1), ("d", 2, "text", "x $$a$$ $$b", 2), ("d", 3, "table", "|a|\n|---|", 2), ("d", 4, "text", None, 3)]
    lists = {r.page_number: r for r in blocks.page_lists_v1(items(spark, rows)).collect()}
    assert lists[1].sections == ["1 A"] and lists[1].figures == ["[Figure]"] and lists[3].sections == []
    pages = blocks.pages(blocks.extract(items(spark, rows))).drop("blocks").join(blocks.page_lists_v1(items(spark, rows)), ["document_id", "page_number"])
    got = {r.page_number: r for r in blocks.page_features(pages).collect()}
    assert set(got) == {1, 2} and got[2].formulas == 1 and got[2].has_table and got[1].sections == 1


def test_redelivered_blocks_count_once(spark):
    rows = [(1, "d", 0, "a", 1), (2, "d", 0, "b", 5), (3, "d", 1, "c", 2)]
    df = spark.createDataFrame(rows, "block_row long, document_id string, block_order int, text string, loaded_at int")
    assert sorted(r.text for r in blocks.latest(df).collect()) == ["b", "c"]
