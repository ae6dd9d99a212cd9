"""From hits to a context, an answer and citations."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Extractive:
    """Offline stand-in for a language model: the first passage of the context."""

    def answer(self, question: str, context: str) -> str:
        return context.split("\n\n", 1)[0] if context else "No passage was found."


def context(hits: DataFrame, text: str = "text") -> DataFrame:
    """Per query: the texts of its hits by rank, joined by blank lines, with sources and scores."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text"), F.col("source").alias("source"), "score")))
    return hits.groupBy("query_id").agg(ranked.alias("h")).select(
        "query_id", F.array_join(F.col("h.text"), "\n\n").alias("context"), F.col("h.source").alias("sources"), F.col("h.score").alias("scores")
    )


def citations(contexts: DataFrame) -> DataFrame:
    """One line per source: its number from 1, the source and the similarity."""
    rows = contexts.select("query_id", F.posexplode(F.arrays_zip("sources", "scores")).alias("i", "c"))
    return rows.select("query_id", (F.col("i") + 1).alias("position"), F.format_string("[%d] %s (similarity: %.4f)", F.col("i") + 1, F.col("c.sources"), F.col("c.scores")).alias("citation"))


def ask(store, name: str, embedder, question: str, generator: Generator = Extractive(), k: int = 5) -> dict:
    """Retrieve, build the context and answer; k bounds what reaches the driver."""
    hits = store.search(name, embedder.embed_query(question), k).orderBy("rank").collect()
    passages = [h["payload"].get("text", "") for h in hits]
    return {
        "answer": generator.answer(question, "\n\n".join(passages)),
        "sources": [h["payload"].get("source_path") or h["payload"].get("document_id", "") for h in hits],
        "scores": [float(h["score"]) for h in hits],
    }
