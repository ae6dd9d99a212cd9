"""From parser items to typed, ordered blocks with their sections.

Items: document_id, seq, kind, text, page_no, item_level, caption, table_md.

State that runs through a document (order numbers, section numbers, the
section stack) is computed in slices of ``SLICE`` positions: a window inside
each slice, a summary per slice, and a carry over the few summaries of a
document.  No task holds more of a document than a slice of it, however long
the document is.

The section stack is a fold over the headings of a slice: a heading takes the
place of all headings of its level and deeper ones, whatever the levels are.
What a slice does to the stack before it is told by its lowest level (what
survives is above it) and the stack it ends with, so slices are folded in the
same way, ``SLICE`` at a time, and these again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import breadcrumb, canonical_type, count_of, number_level, py_strip

SLICE = 4096
ATOMIC = ("table", "figure", "formula", "code")
KINDS = ("title", "heading", "table", "formula", "figure", "code", "list_item", "text")


def latest(rows: DataFrame, order: str = "block_order") -> DataFrame:
    """One row per (document_id, order): the one loaded last; with its ``slice`` of the document.

    Rows are laid out by document and slice, which serves this and what follows in slices: texts are shuffled once."""
    sliced = rows.withColumn("slice", F.floor(F.col(order) / SLICE)).repartition("document_id", "slice")
    newest = Window.partitionBy("document_id", "slice", order).orderBy(F.desc("loaded_at"), F.desc("block_row"))
    return sliced.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _delivered(blocks: DataFrame) -> DataFrame:
    """Delivered block rows in the columns of items, every delivery still there."""
    return blocks.select(
        "document_id", F.col("block_order").alias("seq"), canonical_type("block_type").alias("kind"), "text", F.col("page_number").alias("page_no"), F.col("heading_level").alias("item_level"),
        "caption", F.lit(None).cast("string").alias("table_md"), "loaded_at", "block_row",
    )


def items_from_blocks(blocks: DataFrame) -> DataFrame:
    """The item relation from delivered block rows."""
    return latest(_delivered(blocks), "seq").drop("loaded_at", "block_row")


def block_type() -> Column:
    """Known kinds keep their name; another kind that speaks of a list is a list item."""
    kind = F.col("kind")
    return F.when(kind.isin(*KINDS), kind).when(F.lower(kind).contains("list"), "list_item")


def block_text() -> Column:
    """Stripped text; a figure's caption or a placeholder; a table's markdown where there is one."""
    kind = F.col("kind")
    figure = F.coalesce(F.nullif(py_strip(F.coalesce("caption", F.lit(""))), F.lit("")), F.lit("[Figure]"))
    table = F.coalesce("table_md", "text")
    return F.when(kind == "figure", figure).otherwise(py_strip(F.when(kind == "table", table).otherwise(F.col("text"))))


def _prepared(items: DataFrame) -> DataFrame:
    """Everything about an item that its own row tells; ``kept`` says whether it becomes a block.

    It is computed before any shuffle, so that what only counts rows doesn't carry texts."""
    kept = F.col("page_no").isNotNull() & F.col("block_type").isNotNull() & ((F.col("block_type") == "figure") | (F.col("text") != ""))
    rows = items.select(*[c for c in ("slice", "loaded_at", "block_row") if c in items.columns], "document_id", "seq", "page_no", block_type().alias("block_type"), block_text().alias("text"), "item_level", F.coalesce("caption", F.lit("")).alias("caption"))
    heading = F.col("block_type") == "heading"
    return rows.withColumns(
        {
            "kept": F.coalesce(kept, F.lit(False)), "page_number": F.col("page_no").cast("int"), "heading": F.coalesce(heading, F.lit(False)), "head": F.when(heading, F.col("text")),
            "heading_level": F.when(heading, F.coalesce(number_level("text"), "item_level", F.lit(1))),
        }
    ).drop("page_no")


def typed(items: DataFrame) -> DataFrame:
    """Items that become blocks: on a page, of a known type, not blank (figures always stay)."""
    return _prepared(items).where("kept").drop("kept")


def extract_delivered(blocks: DataFrame) -> DataFrame:
    """Blocks of delivered rows, the last delivery of each."""
    return _numbered(latest(_prepared(_delivered(blocks)), "seq").where("kept"))


def extract(items: DataFrame) -> DataFrame:
    """Blocks with order, section number, section path and heading level."""
    rows = typed(items)
    return _numbered(rows if "slice" in rows.columns else rows.withColumn("slice", F.floor(F.col("seq") / SLICE)))


_STACK = "array<struct<level:int,text:string>>"
#: Above every level.
NO_LEVEL = 2**31 - 1


def _above(stack: Column, level: Column) -> Column:
    return F.filter(stack, lambda s: s["level"] < level)


def _fold(entries: Column, after: bool) -> Column:
    """Stacks along ``entries`` (low: the lowest level, stack: what is put on what survives): ``out`` has the stack and the lowest level so far after each entry, or before it."""
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.lit(NO_LEVEL).alias("low"), F.array().cast(f"array<struct<stack:{_STACK},low:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = F.struct(F.concat(_above(a["stack"], x["low"]), x["stack"]).alias("stack"), F.least(a["low"], x["low"]).alias("low"))
        shown = lambda n: n if after else F.struct(a["stack"].alias("stack"), a["low"].alias("low"))
        return F.element_at(F.transform(F.array(new), lambda n: F.struct(n["stack"].alias("stack"), n["low"].alias("low"), F.concat(a["out"], F.array(shown(n))).alias("out"))), 1)

    return F.aggregate(entries, start, step)


def _carried(slices: DataFrame) -> DataFrame:
    """``slices`` (document_id, slice, low, stack) with the stack ``before`` each."""
    parts = slices.groupBy("document_id", F.floor(F.col("slice") / SLICE).alias("part")).agg(F.array_sort(F.collect_list(F.struct("slice", "low", "stack"))).alias("entries"))
    parts = parts.select("document_id", "part", "entries", _fold(F.col("entries"), False).alias("f"))
    whole = parts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("part", F.col("f.low").alias("low"), F.col("f.stack").alias("stack")))).alias("entries"))
    whole = whole.select("document_id", F.explode(F.arrays_zip(F.col("entries.part").alias("part"), _fold(F.col("entries"), False)["out"].alias("o"))).alias("x")).select("document_id", "x.part", F.col("x.o.stack").alias("base"))
    each = parts.join(whole, ["document_id", "part"]).select("document_id", "base", F.explode(F.arrays_zip(F.col("entries.slice").alias("slice"), F.col("f.out").alias("o"))).alias("x"))
    return each.select("document_id", "x.slice", F.concat(_above(F.col("base"), F.col("x.o.low")), F.col("x.o.stack")).alias("before"))


def _heads(order: str, level: str, text: str) -> Column:
    """The headings of a group in order, as entries of ``_fold``."""
    listed = F.array_sort(F.collect_list(F.when(F.col("heading"), F.struct(F.col(order).alias("at"), F.col(level).cast("int").alias("low"), F.col(text).alias("text")))))
    return F.transform(listed, lambda h: F.struct(h["low"].alias("low"), F.array(F.struct(h["low"].alias("level"), h["text"].alias("text"))).alias("stack")))


def _path(count: Column, out: Column, before: Column) -> Column:
    """The section path after ``count`` headings of a slice."""
    last = F.try_element_at(out, F.greatest(count, F.lit(1)).cast("int"))
    stack = F.when(count == 0, before).otherwise(F.concat(_above(before, last["low"]), last["stack"]))
    return F.transform(stack, lambda s: s["text"])


def _with_paths(rows: DataFrame, order: str, level: str, text: str) -> DataFrame:
    """``rows`` (document_id, slice, heading) with ``path`` and the numbers of rows (``n``) and headings (``h``) so far in the document."""
    inside = Window.partitionBy("document_id", "slice").orderBy(order)
    local = rows.select("*", F.row_number().over(inside).alias("_n"), F.count_if("heading").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_h"))
    slices = local.groupBy("document_id", "slice").agg(F.count("*").alias("rows"), F.count_if("heading").alias("heads"), _heads(order, level, text).alias("entries"))
    slices = slices.select("document_id", "slice", "rows", "heads", _fold(F.col("entries"), True).alias("f"))
    earlier = Window.partitionBy("document_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.select("document_id", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("heads").over(earlier), F.lit(0)).alias("heads_before"), F.col("f.low").alias("low"), F.col("f.stack").alias("stack"), F.col("f.out").alias("out"))
    carry = sums.join(_carried(sums.select("document_id", "slice", "low", "stack")), ["document_id", "slice"]).drop("low", "stack")
    full = local.join(carry, ["document_id", "slice"])
    return full.select(*rows.columns, (F.col("_n") + F.col("rows_before")).alias("n"), (F.col("_h") + F.col("heads_before")).alias("h"), _path(F.col("_h"), F.col("out"), F.col("before")).alias("path"))


def _numbered(rows: DataFrame) -> DataFrame:
    full = _with_paths(rows, "seq", "heading_level", "head")
    title = F.col("block_type") == "title"
    return full.select(
        "document_id", "page_number", (F.col("n") - 1).cast("int").alias("block_order"), "block_type", "text",
        F.when(~title, F.nullif(F.col("h"), F.lit(0)).cast("int")).alias("section_id"), F.when(title, F.array().cast("array<string>")).otherwise(F.col("path")).alias("section_path"), "heading_level",
        F.when(F.col("block_type") == "figure", F.col("caption")).alias("caption"), F.when(F.col("block_type").isin(*ATOMIC), F.lit(True)).alias("atomic"),
    )


def paths_v1(items: DataFrame) -> DataFrame:
    """Section paths by the older rule: the first level - 1 entries of the path before, then the text.

    Titles count as headings, the level is the item's or 1, texts stay as they
    are.  The i-th heading's path has min(length before, level - 1) + 1
    entries, which is i + min(0, the least level - number of a heading so
    far): a running minimum.  With these lengths as levels the paths are those
    of the stack, so that both are computed in slices."""
    heads = items.where("page_no is not null and kind in ('title', 'heading')").select(
        "document_id", "seq", F.floor(F.col("seq") / SLICE).alias("slice"), F.col("page_no").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"), F.greatest(F.coalesce("item_level", F.lit(1)), F.lit(1)).cast("long").alias("level"), F.lit(True).alias("heading"),
    )
    inside = Window.partitionBy("document_id", "slice").orderBy("seq")
    local = heads.withColumn("i", F.row_number().over(inside)).withColumn("least", F.min(F.col("level") - F.col("i")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("document_id", "slice").agg(F.count("*").alias("rows"), F.min("least").alias("low"))
    earlier = Window.partitionBy("document_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("rows_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    ends = ends.select("document_id", "slice", "rows_before", F.coalesce(F.min(F.col("low") - F.col("rows_before")).over(earlier), F.lit(0)).alias("low_before"))
    number = F.col("i") + F.col("rows_before")
    lengths = local.join(ends, ["document_id", "slice"]).withColumn("length", number + F.least(F.lit(0), F.col("low_before"), F.col("least") - F.col("rows_before")))
    return _with_paths(lengths.select("document_id", "slice", "seq", "page_number", "text", "length", "heading"), "seq", "length", "text").select("document_id", "seq", "page_number", "text", F.col("path").alias("section_path"))


def page_lists_v1(items: DataFrame) -> DataFrame:
    """Per page: section lines and figure texts in reading order; pages with no block are pages too."""
    pages = items.where("page_no is not null").groupBy("document_id", F.col("page_no").cast("int").alias("page_number")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "figure", F.struct("seq", block_text().alias("t"))))), lambda x: x.t).alias("figures")
    )
    lines = paths_v1(items).groupBy("document_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", breadcrumb("section_path").alias("t")))), lambda x: x.t).alias("sections"))
    return pages.join(lines, ["document_id", "page_number"], "left").select("document_id", "page_number", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), "figures")


def type_counts(blocks: DataFrame) -> DataFrame:
    """Per document: a map from block type to count."""
    counts = blocks.groupBy("document_id", "block_type").agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "n")))).alias("block_types"))


def document_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id").agg(F.countDistinct("page_number").alias("page_count"), F.count("*").alias("block_count"))


def pages(blocks: DataFrame) -> DataFrame:
    """Blocks of each page in order, with the page's text."""
    listed = F.array_sort(F.collect_list(F.struct("block_order", "block_type", "text")))
    return blocks.groupBy("document_id", "page_number").agg(listed.alias("blocks")).select(
        "document_id", "page_number", "blocks", F.array_join(F.transform("blocks", lambda b: b.text), "\n").alias("text")
    )


def page_features(pages_with_lists: DataFrame) -> DataFrame:
    """Counts per page: characters, sections, figures, table marks and formulas."""
    text = F.col("text")
    return pages_with_lists.select(
        "document_id", "page_number", F.length(text).alias("characters"), F.size("sections").alias("sections"), F.size("figures").alias("figures"),
        (text.contains("|---|") | text.contains("| --- |")).alias("has_table"), F.floor(count_of(text, "$$") / 2).cast("int").alias("formulas"),
    )


def without_blocks(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents of which no block was kept, with the error of the load or the reason."""
    return documents.join(blocks.select("document_id").distinct(), "document_id", "left_anti").withColumn("error", F.coalesce("error", F.lit("no content was extracted")))
