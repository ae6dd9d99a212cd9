"""Checks of chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("document_name", "source_path", "mime_type", "page_number", "chunk_index", "strategy")


def oversized(chunks: DataFrame, max_tokens: int) -> DataFrame:
    return chunks.where(F.col("token_count") > max_tokens)


def missing_keys(chunks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Chunks with required metadata that is absent, or without an id."""
    present = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]), present)
    rows = chunks.select("*", lacking.alias("missing"), (F.coalesce("chunk_id", F.lit("")) == "").alias("empty_id"))
    return rows.where((F.size("missing") > 0) | F.col("empty_id"))


def sectionless(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.size(F.coalesce("section_path", F.array().cast("array<string>"))) == 0)


def atomic(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.coalesce("atomic", F.lit(False)))


def index_check(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the chunk indexes of each group are 0, 1, 2, ... without gap or repeat."""
    stats = chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.countDistinct("chunk_index").alias("distinct"))
    return stats.select(*keys, "chunks", ((F.col("low") == 0) & (F.col("high") == F.col("chunks") - 1) & (F.col("distinct") == F.col("chunks"))).alias("contiguous"))


def token_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.max("token_count").alias("max_tokens"), F.sum("token_count").alias("tokens"), F.count_if(F.coalesce("atomic", F.lit(False))).alias("atomic_chunks"))


def vector_check(vectors: DataFrame, dimension: int, column: str = "vector") -> DataFrame:
    """One row: number of vectors, those of another dimension, and whether all fit."""
    fits = F.coalesce(F.size(column) == dimension, F.lit(False))
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(~fits).alias("wrong"), F.coalesce(F.bool_and(fits), F.lit(True)).alias("all_fit"))


def pair_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors by key, in one join; it fails when it meets a chunk without a vector or a vector without a chunk."""
    both = chunks.withColumn("_chunk", F.lit(True)).join(vectors.withColumn("_vector", F.lit(True)), key, "full")
    whole = F.col("_chunk").isNotNull() & F.col("_vector").isNotNull()
    return both.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("number of vectors differs from number of chunks")).cast("boolean"))).drop("_chunk", "_vector")


def pairing(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: chunks, vectors, chunks without a vector and vectors without a chunk."""
    both = chunks.select(key, F.lit(1).alias("c")).join(vectors.select(key, F.lit(1).alias("v")), key, "full")
    return both.agg(F.count("c").alias("chunks"), F.count("v").alias("vectors"), F.count_if(F.col("v").isNull()).alias("without_vector"), F.count_if(F.col("c").isNull()).alias("without_chunk"))
