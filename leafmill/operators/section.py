"""Section-, paragraph-, sentence- and token-aware chunks of a page.

All levels are native expressions over the paragraphs of a run, which a page
bounds: runs of one section path by lag and running sum, greedy packing by a
fold, sentences by a pattern, tokens by white space.  Another tokenizer can be
put in: a pair of expressions (``Tokenizer``), or a Python function over Arrow
batches (``ArrowTokenizer``), such as a byte-pair encoder.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.ids import chunk_id
from leafmill.functions.text import py_strip
from leafmill.operators.blocks import ATOMIC

SENTENCE = r"(?s).*?[.!?]+(?:\s+|$)|.+$"


@dataclass(frozen=True)
class Tokenizer:
    """``encode``: text -> array of tokens; ``decode``: array of tokens -> text."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))

    def encode_each(self, texts: Column) -> Column:
        return F.transform(texts, self.encode)


@dataclass(frozen=True)
class ArrowTokenizer:
    """A tokenizer in Python, called with many texts at a time.

    ``split``: texts -> lists of strings, which joined by ``joint`` give the text again."""

    split: Callable[[list[str]], list[list[str]]]
    joint: str = ""

    def encode(self, text: Column) -> Column:
        split = self.split

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(split(["" if t is None else t for t in texts]), index=texts.index, dtype=object)

        return run(text)

    def decode(self, tokens: Column) -> Column:
        return F.array_join(tokens, self.joint)

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))

    def encode_each(self, texts: Column) -> Column:
        split = self.split

        @F.pandas_udf("array<array<string>>")
        def run(lists: pd.Series) -> pd.Series:
            sizes = [0 if a is None else len(a) for a in lists]
            flat = iter(split([t for a in lists if a is not None for t in a]))
            return pd.Series([[list(next(flat)) for _ in range(n)] for n in sizes], index=lists.index, dtype=object)

        return run(texts)


#: Words between white space; a window of words is joined by single blanks again.
WORDS = Tokenizer(lambda t: F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)), lambda a: F.array_join(a, " "))


def sentences(text: Column) -> Column:
    """Stripped, non-blank sentences by end marks followed by white space."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), py_strip), lambda s: s != "")


def pack(counts: Column, most: int) -> Column:
    """Group number of each count: greedy sums up to ``most``; a larger count is a group of its own."""
    start = F.struct(F.lit(-1).alias("group"), F.lit(0).alias("used"), F.lit(False).alias("large"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, k: Column) -> Column:
        large = k > most
        fresh = (a["group"] < 0) | large | a["large"] | (a["used"] + k > most)
        group = F.when(fresh, a["group"] + 1).otherwise(a["group"])
        used = F.when(large, F.lit(0)).when(fresh, k).otherwise(a["used"] + k)
        return F.struct(group.alias("group"), used.alias("used"), large.alias("large"), F.concat(a["out"], F.array(group)).alias("out"))

    return F.aggregate(counts, start, step, lambda a: a["out"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, although it is used several times or within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grouped(parts: Column, most: int) -> Column:
    """Packed groups of ``parts`` (structs with ``n``, their count) in order."""

    def split(groups: Column, parts: Column) -> Column:
        n = F.size(parts)
        starts = F.filter(F.sequence(F.lit(-1), n - 1), lambda k: (k == 0) | (k > 0) & (F.get(groups, k) != F.get(groups, k - 1)))
        return let(starts, lambda every: F.transform(every, lambda k, i: F.slice(parts, k + 1, F.coalesce(F.get(every, i + 1), n) - k)))

    return let(parts, lambda p: let(pack(F.transform(p, lambda x: x["n"]), most), lambda g: split(g, p)))


def windows(tokens: Column, most: int, tokenizer: Tokenizer | ArrowTokenizer) -> Column:
    """Consecutive windows of ``most`` tokens as text; blank ones dropped."""
    starts = F.filter(F.sequence(F.lit(-most), F.size(tokens) - 1, F.lit(most)), lambda s: s >= 0)
    return F.filter(F.transform(starts, lambda s: py_strip(tokenizer.decode(F.slice(tokens, s + 1, F.lit(most))))), lambda t: t != "")


def token_windows(text: Column, most: int, tokenizer: Tokenizer) -> Column:
    """``windows`` of a text."""
    return let(tokenizer.encode(text), lambda tokens: windows(tokens, most, tokenizer))


def _large(group: Column, most: int) -> Column:
    return (F.size(group) == 1) & (group[0]["n"] > most)


def _texts(group: Column) -> Column:
    return F.transform(group, lambda x: x["t"])


def sentence_pieces(parts: Column, most: int, tokenizer: Tokenizer | ArrowTokenizer) -> Column:
    """Pieces of a paragraph that is too large from its sentences (t: text, n: count, w: tokens): packed, joined by a blank; larger ones by token windows."""
    return F.flatten(F.transform(grouped(parts, most), lambda g: F.when(_large(g, most), windows(g[0]["w"], most, tokenizer)).otherwise(F.array(F.array_join(_texts(g), " ")))))


def _measured(rows: DataFrame, most: int, tokenizer: Tokenizer | ArrowTokenizer) -> DataFrame:
    """``rows`` with the count ``n`` of their text and, where it is too large, its tokens ``w`` and sentences ``s`` with theirs."""
    counted = rows.withColumn("w", tokenizer.encode(F.col("text"))).withColumn("n", F.size("w"))
    large = F.col("n") > most
    parts = counted.withColumns({"w": F.when(large, F.col("w")), "s": F.when(large & ~F.col("is_atomic"), sentences(F.col("text"))).otherwise(F.array().cast("array<string>"))})
    parts = parts.withColumn("sw", tokenizer.encode_each(F.col("s")))
    return parts.withColumn("s", F.zip_with("s", "sw", lambda t, w: F.struct(t.alias("t"), F.size(w).alias("n"), w.alias("w")))).drop("sw")


def runs(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of their run on the page: a run ends where the path or atomicity changes; an atomic block is a run of its own.

    Blank blocks take part in this and are dropped later."""
    page = Window.partitionBy("document_id", "page_number").orderBy("block_order")
    rows = blocks.withColumn("path", F.coalesce("section_path", F.array().cast("array<string>"))).withColumn("is_atomic", F.col("block_type").isin(*ATOMIC))
    change = F.col("is_atomic") | F.coalesce(F.lag("is_atomic").over(page), F.lit(True)) | ~F.col("path").eqNullSafe(F.lag("path").over(page))
    return rows.withColumn("change", change.cast("int")).withColumn("run", F.sum("change").over(page.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("change", "section_path").withColumnRenamed("path", "section_path")


def section_chunks(blocks: DataFrame, max_tokens: int = 800, tokenizer: Tokenizer | ArrowTokenizer = WORDS) -> DataFrame:
    """Chunks that mix neither sections nor pages."""
    if max_tokens <= 0:
        raise ValueError("a chunk needs room for at least one token")
    numbered = _measured(runs(blocks).withColumn("text", py_strip("text")).where("text <> ''"), max_tokens, tokenizer)
    per_run = numbered.groupBy("document_id", "page_number", "run").agg(
        F.array_sort(F.collect_list(F.struct("block_order", F.col("text").alias("t"), "n", "w", "s"))).alias("p"), F.any_value("section_path").alias("section_path"), F.any_value("is_atomic").alias("is_atomic"), F.any_value("block_type").alias("block_type")
    )
    text_pieces = F.flatten(F.transform(grouped(F.col("p"), max_tokens), lambda g: F.when(_large(g, max_tokens), sentence_pieces(g[0]["s"], max_tokens, tokenizer)).otherwise(F.array(F.array_join(_texts(g), "\n\n")))))
    whole = F.col("p")[0]["n"] <= max_tokens
    atomic_pieces = F.when(whole, F.col("p.t")).otherwise(windows(F.col("p")[0]["w"], max_tokens, tokenizer))
    pieces = per_run.select(
        "document_id", "page_number", "run", "section_path", F.when(F.col("is_atomic"), F.col("block_type")).otherwise("text").alias("chunk_type"), F.when(F.col("is_atomic"), whole).alias("atomic"),
        F.posexplode(F.when(F.col("is_atomic"), atomic_pieces).otherwise(text_pieces)).alias("piece", "text"),
    )
    page = Window.partitionBy("document_id", "page_number").orderBy("run", "piece")
    return pieces.select(
        chunk_id(F.col("document_id"), F.col("page_number"), F.col("text")).alias("chunk_id"), "document_id", "text", "page_number", (F.row_number().over(page) - 1).alias("chunk_index"),
        F.lit("section_aware").alias("strategy"), "section_path", "chunk_type", tokenizer.count(F.col("text")).alias("token_count"), "atomic",
    )
