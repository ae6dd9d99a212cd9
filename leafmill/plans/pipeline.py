"""From loaded files to a searchable collection: blocks, chunks with their documents' names, vectors, points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.errors import LoaderError
from leafmill.operators import blocks, section, validate
from leafmill.operators.embed import Embedder, embed
from leafmill.operators.store import Store, points
from leafmill.sources.tables import KEYS_SENT, cut

#: What a chunk carries of its document.
DOCUMENT = ("document_name", "source_path", "mime_type")
#: What a point carries beside its text, chunk and document.
METADATA = (*DOCUMENT, "page_number", "chunk_index", "strategy", "chunk_type", "section_path", "token_count", "atomic")


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with name, path and mime type of their document; the size of ``documents`` decides how they are joined."""
    known = documents.groupBy("document_id").agg(*[F.max(c).alias(c) for c in DOCUMENT])
    few = documents.limit(KEYS_SENT + 1).count() <= KEYS_SENT
    return chunks.join(F.broadcast(known) if few else known, "document_id", "left")


def items_of_pages(pages: DataFrame) -> DataFrame:
    """Pages of plain texts as items: a paragraph between blank lines is a text, a line with leading number signs a heading of that level."""
    parts = pages.where("text is not null").select("document_id", "page_number", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("seq", "t"))
    marks = F.regexp_extract(F.trim("t"), r"^(#{1,6})[ \t]+[^\n]+$", 1)
    return parts.select(
        "document_id", "seq", F.when(marks != "", "heading").otherwise("text").alias("kind"), F.when(marks != "", F.regexp_replace(F.trim("t"), r"^#+[ \t]+", "")).otherwise(F.col("t")).alias("text"),
        F.col("page_number").cast("int").alias("page_no"), F.when(marks != "", F.length(marks)).alias("item_level"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("table_md"),
    )


def document_chunks(items: DataFrame, documents: DataFrame, max_tokens: int = 800) -> DataFrame:
    """Section-aware chunks of items, with what the metadata contract asks for."""
    return with_documents(section.section_chunks(blocks.extract(items), max_tokens), documents)


def chunk_points(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Points of chunks; a chunk id that occurs several times (equal text of a page) is one point."""
    first = chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "chunk_id"]), F.struct("document_id", "page_number", "chunk_index")).alias("c")).select("chunk_id", "c.*")
    vectors = embed(first, "chunk_id", "text", embedder)
    rows = validate.pair_vectors(first, vectors).withColumn("section_path", F.array_join("section_path", " > "))
    return points(rows, list(METADATA))


def ingest_documents(store: Store, name: str, documents: DataFrame, items: DataFrame, embedder: Embedder, max_tokens: int = 800) -> dict:
    """Chunk, embed and store loaded documents; documents without content and loads without chunks are errors.

    ``documents``: document_id, document_name, source_path, mime_type; ``items`` as parsers give them (see ``items_of_pages`` for plain texts)."""
    if items.isEmpty():
        raise LoaderError("no content was extracted")
    chunks = cut(document_chunks(items, documents, max_tokens))
    made = chunks.count()
    if not made:
        raise LoaderError("no chunk was made")
    store.create(name, embedder.dimension)
    store.upsert(name, chunk_points(chunks, embedder))
    return {"collection": name, "chunks": made, "points": store.stats(name).first()["points"]}
