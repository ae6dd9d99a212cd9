"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.config import EmbeddingConfig
from leafmill.functions import ids, text
from leafmill.operators import blocks, embed, fixed, qa, search, section, store, validate
from leafmill.plans import oracles, pipeline
from leafmill.sources import files
from leafmill.sources.tables import spread, table

FLAGSHIP = "section_chunks"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.SQL

#: Parameters of the registered queries, small enough that every branch occurs.
PARAGRAPH_TOKENS, SENTENCE_TOKENS, WINDOW_TOKENS, CHUNK_TOKENS = 80, 25, 20, 60
NEIGHBOURS = 5
#: Rows loaded from then on are the new ones of the upsert.
NEW_FROM = "2025-07-01 00:00:00"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register; whole numbers come out as BIGINT."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        small = (T.IntegerType, T.ShortType, T.ByteType)
        return df.select(*[F.col(c.name).cast("bigint").alias(c.name) if isinstance(c.dataType, small) else F.col(c.name) for c in df.schema])

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    QUERIES[f.__name__] = run
    return run


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.items_from_blocks(table(spark, sf_dir, "blocks"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract_delivered(table(spark, sf_dir, "blocks"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each chunk id."""
    return store.last_wins(table(spark, sf_dir, "chunks").withColumn("position", F.struct("loaded_at", "chunk_row")), "chunk_id", "position").drop("position")


# documents


@query
def load_text(spark, sf_dir):
    """Texts as a loader gives them: one page with Unix newlines."""
    pages = files.normalised_text(table(spark, sf_dir, "documents"), "doc_id", "text").where("text is not null")
    return pages.select("doc_id", "page_number", F.length("text").alias("characters"), ids.content_id("text").alias("content_id"))


@query
def document_id(spark, sf_dir):
    """Content hash of every document."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ids.content_id("text").alias("content_id"))


@query
def fixed_chunks(spark, sf_dir):
    """Fixed windows of 1000 code points with an overlap of 200."""
    return fixed.fixed_chunks(table(spark, sf_dir, "documents"), key="doc_id").drop("page_number")


@query
def fixed_chunk_stats(spark, sf_dir):
    """Number and size of the windows per document."""
    windows = fixed.fixed_chunks(table(spark, sf_dir, "documents"), key="doc_id")
    return windows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("total_chunks").alias("total_chunks"), F.max("end_char").alias("end_char"), F.sum(F.length("text")).alias("characters"))


@query
def csv_row_render(spark, sf_dir):
    """Customers as records of key: value."""
    columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    return files.render_rows(table(spark, sf_dir, "customer"), columns).select("c_custkey", "text")


# blocks


@query
def strip_nonblank(spark, sf_dir):
    """Stripped texts of blocks that aren't blank."""
    stripped = table(spark, sf_dir, "blocks").select("block_row", text.py_strip("text").alias("text"))
    return stripped.where("text <> ''")


@query
def figure_caption(spark, sf_dir):
    """Text of every figure: its caption or a placeholder."""
    figures = blocks.typed(_items(spark, sf_dir)).where("block_type = 'figure'")
    return figures.select("document_id", "seq", "text", "caption")


@query
def heading_level(spark, sf_dir):
    """Level of every heading: by number, else by the item, else 1."""
    heads = blocks.typed(_items(spark, sf_dir)).where("block_type = 'heading'")
    return heads.select("document_id", "seq", "text", text.number_level("text").alias("number_level"), F.coalesce(text.number_level("text"), "item_level", F.lit(1)).alias("level"))


@query
def block_extract(spark, sf_dir):
    """Typed, ordered blocks of all documents."""
    return _blocks(spark, sf_dir).select("document_id", "page_number", "block_order", "block_type", "text", F.coalesce("atomic", F.lit(False)).alias("atomic"))


@query
def section_ids(spark, sf_dir):
    """Section number of every block."""
    return _blocks(spark, sf_dir).select("document_id", "block_order", "section_id", "heading_level")


@query
def section_paths(spark, sf_dir):
    """Section path of every block."""
    return _blocks(spark, sf_dir).select("document_id", "block_order", text.breadcrumb("section_path").alias("path"), F.size("section_path").alias("depth"))


@query
def section_paths_v1(spark, sf_dir):
    """Section paths of titles and headings by the older rule."""
    return blocks.paths_v1(_items(spark, sf_dir)).select("document_id", "seq", text.breadcrumb("section_path").alias("path"))


@query
def block_type_counts(spark, sf_dir):
    """Blocks per document and type."""
    counts = blocks.type_counts(_blocks(spark, sf_dir))
    shown = F.transform(F.array_sort(F.map_entries("block_types")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counts.select("document_id", F.array_join(shown, ",").alias("block_types"))


@query
def document_stats(spark, sf_dir):
    """Pages and blocks per document."""
    return blocks.document_stats(_blocks(spark, sf_dir))


@query
def page_groups(spark, sf_dir):
    """Pages with their blocks in order."""
    pages = blocks.pages(_blocks(spark, sf_dir))
    return pages.select("document_id", "page_number", F.size("blocks").alias("blocks"), ids.content_id("text").alias("text_id"))


@query
def empty_documents(spark, sf_dir):
    """Loaded documents without any block."""
    return blocks.without_blocks(table(spark, sf_dir, "loaded_documents"), _blocks(spark, sf_dir)).select("document_id", "error")


@query
def page_sections(spark, sf_dir):
    """Section lines and figure texts of every page by the older profile."""
    pages = blocks.page_lists_v1(_items(spark, sf_dir))
    return pages.select("document_id", "page_number", F.array_join("sections", " / ").alias("sections"), F.array_join("figures", " / ").alias("figures"))


@query
def page_feature_stats(spark, sf_dir):
    """Characters, sections, figures, tables and formulas by document."""
    items = _items(spark, sf_dir)
    pages = blocks.pages(_blocks(spark, sf_dir)).drop("blocks").join(blocks.page_lists_v1(items), ["document_id", "page_number"])
    return blocks.page_features(pages).groupBy("document_id").agg(
        F.count("*").alias("pages"), F.sum("characters").alias("characters"), F.sum("figures").alias("figures"), F.count_if(F.col("sections") > 0).alias("pages_with_sections"),
        F.count_if("has_table").alias("pages_with_tables"), F.sum("formulas").alias("formulas"),
    )


# chunking


@query
def section_runs(spark, sf_dir):
    """Runs of one section path on each page."""
    runs = section.runs(_blocks(spark, sf_dir))
    return runs.groupBy("document_id", "page_number", "run").agg(F.count("*").alias("blocks"), F.min("block_order").alias("first_order"), text.breadcrumb(F.any_value("section_path")).alias("path"))


@query
def paragraph_packing(spark, sf_dir):
    """Group of every paragraph of the text runs."""
    runs = section.runs(_blocks(spark, sf_dir)).where("not is_atomic and text <> ''")
    listed = runs.groupBy("document_id", "page_number", "run").agg(F.array_sort(F.collect_list(F.struct("block_order", section.WORDS.count(F.col("text")).alias("n")))).alias("p"))
    packed = listed.select("document_id", "page_number", "run", F.posexplode(F.arrays_zip("p.block_order", section.pack(F.col("p.n"), PARAGRAPH_TOKENS).alias("g"))).alias("pos", "x"))
    return packed.select("document_id", "page_number", "run", F.col("x.block_order").alias("block_order"), F.col("x.g").alias("group_no"))


@query
def sentence_packing(spark, sf_dir):
    """Group of every sentence of the blocks of text runs."""
    rows = _blocks(spark, sf_dir).where(~F.col("block_type").isin(*blocks.ATOMIC)).select("document_id", "block_order", section.sentences(F.col("text")).alias("s"))
    counts = F.transform("s", section.WORDS.count)
    packed = rows.select("document_id", "block_order", F.posexplode(F.arrays_zip(F.col("s"), section.pack(counts, SENTENCE_TOKENS).alias("g"))).alias("sentence_no", "x"))
    return packed.select("document_id", "block_order", "sentence_no", F.col("x.s").alias("sentence"), F.col("x.g").alias("group_no"))


@query
def hard_token_split(spark, sf_dir):
    """Windows of a fixed number of tokens of every block."""
    rows = _blocks(spark, sf_dir)
    return rows.select("document_id", "block_order", F.posexplode(section.token_windows(F.col("text"), WINDOW_TOKENS, section.WORDS)).alias("piece_no", "text"))


@query
def atomic_chunks(spark, sf_dir):
    """Chunks of tables, figures, formulas and code."""
    return section.section_chunks(_blocks(spark, sf_dir), CHUNK_TOKENS).where("atomic is not null").select("chunk_id", "document_id", "page_number", "chunk_type", "token_count", "atomic")


@query
def section_chunks(spark, sf_dir):
    """Section-aware chunks of all documents."""
    chunks = section.section_chunks(_blocks(spark, sf_dir), CHUNK_TOKENS)
    return chunks.select("chunk_id", "document_id", "text", "page_number", "chunk_index", text.breadcrumb("section_path").alias("path"), "chunk_type", "token_count", "atomic")


@query
def chunk_index(spark, sf_dir):
    """Whether the chunk indexes of every page are contiguous."""
    return validate.index_check(section.section_chunks(_blocks(spark, sf_dir), CHUNK_TOKENS), ["document_id", "page_number"])


# chunks


@query
def chunk_preview(spark, sf_dir):
    """The first 250 code points of every chunk on one line."""
    return table(spark, sf_dir, "chunks").select("chunk_row", text.preview("text", 250).alias("preview"))


@query
def breadcrumb(spark, sf_dir):
    """Section path of every chunk as one line."""
    return table(spark, sf_dir, "chunks").select("chunk_row", text.breadcrumb("section_path").alias("path"))


@query
def chunk_ids(spark, sf_dir):
    """Content-addressed key of every chunk."""
    key = ids.chunk_id(F.col("document_id"), F.col("page_number"), F.col("text"))
    return table(spark, sf_dir, "chunks").where("page_number is not null and text is not null").select("chunk_row", key.alias("key"))


@query
def point_ids(spark, sf_dir):
    """Name-based UUID of every chunk."""
    return table(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_row", ids.uuid5("chunk_id").alias("point_id"))


@query
def chunk_stats(spark, sf_dir):
    """Chunks and tokens per document."""
    return validate.token_stats(_chunks(spark, sf_dir), ["document_id"])


@query
def oversized_chunks(spark, sf_dir):
    """Chunks of more than 150 tokens."""
    return validate.oversized(table(spark, sf_dir, "chunks"), 150).select("chunk_row", "token_count")


@query
def metadata_contract(spark, sf_dir):
    """Chunks that lack required metadata."""
    documents = table(spark, sf_dir, "loaded_documents").select("document_id", "document_name", "source_path", "mime_type")
    joined = table(spark, sf_dir, "chunks").join(documents, "document_id", "left")
    return validate.missing_keys(joined).select("chunk_row", F.array_join(F.array_sort("missing"), ",").alias("missing"), "empty_id")


@query
def sectionless_chunks(spark, sf_dir):
    """Chunks without a section path."""
    return validate.sectionless(table(spark, sf_dir, "chunks")).select("chunk_row", "chunk_type")


@query
def atomic_filter(spark, sf_dir):
    """Chunks that are whole tables, figures, formulas or code."""
    return validate.atomic(table(spark, sf_dir, "chunks")).select("chunk_row", "chunk_type")


@query
def page_index_check(spark, sf_dir):
    """Whether the delivered chunk indexes of every page are contiguous."""
    return validate.index_check(_chunks(spark, sf_dir).where("page_number is not null"), ["document_id", "page_number", "strategy"])


# vectors


@query
def vector_validation(spark, sf_dir):
    """Whether the vectors of each label have 64 dimensions."""
    vectors = table(spark, sf_dir, "embeddings")
    fits = F.coalesce(F.size("embedding") == 64, F.lit(False))
    return vectors.groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(~fits).alias("wrong"), F.bool_and(fits).alias("all_fit"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


@query
def cosine_scores(spark, sf_dir):
    """Similarity of every hundredth vector to all vectors."""
    points = table(spark, sf_dir, "embeddings")
    return search.score_set(points, _asked(spark, sf_dir), "vec_id", "vec_id", "embedding").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query
def topk_multi(spark, sf_dir):
    """The nearest vectors of every hundredth vector."""
    best = search.top_k_set(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), NEIGHBOURS, "vec_id", "vec_id", "embedding")
    return best.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query
def topk_search(spark, sf_dir):
    """The vectors nearest to the mean of label 0."""
    points = table(spark, sf_dir, "embeddings")
    mean = points.where("label = 0").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()
    best = search.top_k(points, [r["x"] for r in mean], NEIGHBOURS, "vec_id", "embedding")
    return best.select("vec_id", "label", "rank", F.round("score", 6).alias("score"))


@query
def chunk_vector_join(spark, sf_dir):
    """Chunks with the vector of the same number; those that have none are told by ``vector_pairing``."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_row")
    vectors = vectors.join(table(spark, sf_dir, "chunks").select("chunk_row"), "chunk_row", "left_semi")
    chunks = table(spark, sf_dir, "chunks").select("chunk_row", "document_id").join(vectors.select("chunk_row"), "chunk_row", "left_semi")
    return validate.pair_vectors(chunks, vectors, "chunk_row").select("chunk_row", "document_id", F.size("embedding").alias("dimension"), "label")


@query
def vector_pairing(spark, sf_dir):
    """Chunks and vectors, and those of either that lack the other."""
    return validate.pairing(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_row"), "chunk_row")


def _document_chunks(spark, sf_dir):
    chunks = section.section_chunks(_blocks(spark, sf_dir), CHUNK_TOKENS)
    return pipeline.with_documents(chunks, table(spark, sf_dir, "loaded_documents"))


@query
def chunk_contract(spark, sf_dir):
    """Our own chunks that lack required metadata."""
    return validate.missing_keys(_document_chunks(spark, sf_dir)).select("chunk_id", "page_number", "chunk_index", F.array_join(F.array_sort("missing"), ",").alias("missing"), "empty_id")


@query
def pipeline_points(spark, sf_dir):
    """The points of all documents, from blocks over chunks to payloads."""
    made = pipeline.chunk_points(_document_chunks(spark, sf_dir), embed.HashEmbedder(EmbeddingConfig(dimension=64)))
    payload = F.array_sort(F.map_entries(F.map_filter("payload", lambda k, _: k != "text")))
    return made.select("point_id", F.size("vector").alias("dimension"), F.array_join(F.transform(payload, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("payload"), ids.content_id(F.col("payload")["text"]).alias("text_id"))


@query
def upsert_merge(spark, sf_dir):
    """A collection of chunks after an upsert of those loaded later."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "chunk_row", "document_id", F.struct("loaded_at", "chunk_row").alias("position"))
    new = F.col("position.loaded_at") >= F.lit(NEW_FROM).cast("timestamp")
    old = store.last_wins(rows.where(~new), "chunk_id", "position")
    return store.merged(old, store.last_wins(rows.where(new), "chunk_id", "position"), "chunk_id").drop("position")


@query
def point_payload(spark, sf_dir):
    """Payload of every point; metadata overrides equal keys."""
    rows = table(spark, sf_dir, "chunks")
    base = {c: F.col(c) for c in ("chunk_id", "document_id", "strategy")}
    metadata = {"page_number": F.col("page_number"), "chunk_index": F.col("chunk_index"), "strategy": F.upper("strategy")}
    entries = F.array_sort(F.map_entries(store.payload(base, metadata)))
    return rows.select("chunk_row", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("payload"))


@query
def point_lookup(spark, sf_dir):
    """Points of the chunks that were delivered more than once, by their ids."""
    rows = table(spark, sf_dir, "chunks").withColumn("point_id", ids.uuid5("chunk_id"))
    wanted = rows.groupBy("point_id").agg(F.count("*").alias("deliveries")).where("deliveries > 1")
    return store.last_wins(rows.withColumn("position", F.struct("loaded_at", "chunk_row")), "point_id", "position").join(wanted, "point_id").select("point_id", "chunk_row", "deliveries")


@query
def collection_stats(spark, sf_dir):
    """Points of each document's collection."""
    return _chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("points"), F.countDistinct("strategy").alias("strategies"))


def _hits(spark, sf_dir):
    best = search.top_k_set(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), NEIGHBOURS, "vec_id", "vec_id", "embedding")
    chunks = table(spark, sf_dir, "chunks").select(F.col("chunk_row").alias("vec_id"), F.col("text"), F.col("chunk_id").alias("source"))
    return best.join(chunks, "vec_id")


@query
def citations(spark, sf_dir):
    """Numbered sources of the hits of every query."""
    return qa.citations(qa.context(_hits(spark, sf_dir)))


@query
def answer_context(spark, sf_dir):
    """The joined passages of every query's hits."""
    return qa.context(_hits(spark, sf_dir)).select("query_id", ids.content_id("context").alias("context_id"), F.array_join("sources", ",").alias("sources"))


@query
def hash_embed(spark, sf_dir):
    """Vectors of all chunks by feature hashing."""
    chunks = spread(table(spark, sf_dir, "chunks")).where("text is not null")
    return embed.embed(chunks, "chunk_row", "text", embed.HashEmbedder(EmbeddingConfig(dimension=64)))
