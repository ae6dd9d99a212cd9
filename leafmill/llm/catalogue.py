"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from leafmill.llm import cohesion, mixing, neardup, oracles, packing, scans, sentences, truncation
from leafmill.llm.encode import encode_texts
from leafmill.sources.tables import drop_keys, keep_keys, spread, table

QUERIES: dict = {}
ORACLES: dict = oracles.SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(spread(docs), "doc_id", "text")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loaded_documents").where(F.col("loader") == "scan")


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and list_item blocks of documents that weren't scanned."""
    return drop_keys(sentences.prose(table(spark, sf_dir, "blocks"), "block_type"), _scans(spark, sf_dir), "document_id")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence of the prose blocks."""
    blocks = _prose(spark, sf_dir).select("block_row", "text")
    splitter = sentences.fit(blocks, "block_row", "text")
    return sentences.sentence_ends(spread(blocks.where(F.col("text").isNotNull())), "block_row", "text", splitter)


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.truncated(truncation.inspect(spread(table(spark, sf_dir, "documents")))).select("doc_id")


@query
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the texts of each canonical source were cut off."""
    return truncation.rates(truncation.inspect(spread(table(spark, sf_dir, "documents"))))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose texts are similar."""
    return neardup.similar_pairs(spread(table(spark, sf_dir, "chunks")), "chunk_row", "text")


@query
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted chunk with its group and the number of links of its text."""
    return neardup.groups(spread(table(spark, sf_dir, "chunks")), "chunk_row", "text")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_keys(table(spark, sf_dir, "blocks"), _scans(spark, sf_dir), "document_id")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, page numbers, cut words and misread words by line of the scanned blocks."""
    return scans.defects(_scanned(spark, sf_dir), scans.read_vocabulary(table(spark, sf_dir, "lexicon")))


@query
def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of the scanned documents."""
    return scans.paragraphs(_scanned(spark, sf_dir), scans.read_vocabulary(table(spark, sf_dir, "lexicon")))


def _splitter(spark: SparkSession, sf_dir: str) -> sentences.Splitter:
    return sentences.fit(_prose(spark, sf_dir), "block_row", "text")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The natural division of every oversized block and chunk."""
    return cohesion.divisions(_oversized(spark, sf_dir), _splitter(spark, sf_dir)).select("target", "row_id", "boundary")


@query
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized block and chunk."""
    return cohesion.split_oversized(_oversized(spark, sf_dir), _splitter(spark, sf_dir))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (of documents that weren't scanned) and chunks that may be over their limit."""
    limits = table(spark, sf_dir, "size_limits")
    blocks = drop_keys(cohesion.oversized(table(spark, sf_dir, "blocks"), "block", "block_row", "block_type", "text", limits, "document_id"), _scans(spark, sf_dir), "document_id")
    chunks = cohesion.oversized(table(spark, sf_dir, "chunks"), "chunk", "chunk_row", "chunk_type", "text", limits)
    return blocks.drop("document_id").unionByName(chunks)


def _bins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity = packing.capacity_of(table(spark, sf_dir, "size_limits"))
    items = packing.items_of(_prose(spark, sf_dir), capacity, _splitter(spark, sf_dir))
    return packing.packed(items, capacity), capacity


@query
def p2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose blocks of every document packed into containers."""
    return packing.chunks(*_bins(spark, sf_dir))


@query
def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and free room of every document against the least possible."""
    bins, capacity = _bins(spark, sf_dir)
    return packing.summary(packing.chunks(bins, capacity), capacity)


@query
def p2_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: blocks placed, whole blocks placed more than once or in pieces, and containers over the capacity."""
    bins, capacity = _bins(spark, sf_dir)
    boxes = packing.chunks(bins, capacity)
    blocks = bins.groupBy("document_id", "block_row").agg(F.count("*").alias("pieces"), F.sum("size").alias("size"))
    placed = blocks.groupBy("document_id").agg(F.count("*").alias("blocks"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= capacity * 0.9)).alias("cut_in_vain"))
    over = boxes.groupBy(F.col("document_id").alias("d")).agg(F.count_if(F.col("size") > capacity).alias("over"))
    return placed.join(over, placed.document_id.eqNullSafe(over.d)).select("document_id", "blocks", "cut_in_vain", "over")


#: Domains of the sources of the test tables.
DOMAINS = {
    "lab_reports": "science", "preprint_feed": "science", "field_manuals": "reference", "api_docs": "reference", "wiki_dump": "reference", "ticket_export": "records", "csv_rows": "records",
    "scan_archive": "records", "newsletter": "web", "forum_answers": "web", "micro_digest": "web", "md_notes": "notes", "audio_notes": "notes",
}


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sized(spread(table(spark, sf_dir, "documents")), domains=DOMAINS)


@query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mixture and how often each is used."""
    return mixing.mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reaches in the mixture."""
    rows, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(rows, mixing.mixture(rows, targets), targets)


@query
def p7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: records of the mixture that are used too often, and those listed twice."""
    mix = mixing.mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    per = mix.groupBy("source", "doc_id").agg(F.count("*").alias("rows"), F.sum("uses").alias("uses"))
    targets = table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    return targets.join(per, "source", "left").groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("rows") > 1).alias("twice"))
