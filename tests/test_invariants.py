"""Properties of the results over whole tables."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import blocks, section
from leafmill.plans import catalogue
from leafmill.sources.tables import table


@pytest.fixture(scope="module")
def delivered(spark, tables):
    return table(spark, tables, "blocks")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_the_partitions(spark, delivered, partitions):
    chunks = lambda b: section.section_chunks(blocks.extract_delivered(b), catalogue.CHUNK_TOKENS).select("chunk_id", "page_number", "chunk_index", "token_count")
    assert rows(chunks(delivered.orderBy(F.rand(3)).repartition(partitions))) == rows(chunks(delivered))


def test_redelivery_changes_nothing(delivered):
    later = delivered.withColumn("block_row", F.col("block_row") + 10**6).withColumn("loaded_at", F.col("loaded_at") + F.expr("INTERVAL 1 DAY"))
    assert rows(blocks.extract_delivered(delivered.unionByName(later))) == rows(blocks.extract_delivered(delivered))


def test_small_slices_change_nothing(delivered, monkeypatch):
    whole = rows(blocks.extract_delivered(delivered))
    monkeypatch.setattr(blocks, "SLICE", 5)
    assert rows(blocks.extract_delivered(delivered)) == whole


def test_chunks_keep_sections_budget_and_order(delivered):
    made = blocks.extract_delivered(delivered)
    chunks = section.section_chunks(made, catalogue.CHUNK_TOKENS)
    assert chunks.where(F.col("token_count") > catalogue.CHUNK_TOKENS).count() == 0
    paths = made.select("document_id", "page_number", F.col("section_path").alias("p")).distinct()
    known = (F.col("p") == F.col("section_path")) & (chunks.document_id == paths.document_id) & (chunks.page_number == paths.page_number)
    assert chunks.join(paths, known, "left_anti").count() == 0
    words = lambda df, t: df.agg(F.sum(F.size(F.regexp_extract_all(F.col(t), F.lit(r"\S+"), F.lit(0))))).first()[0]
    assert words(chunks, "text") == words(made, "text")


def test_filters_and_columns_reach_the_scan(spark, tables):
    plan = catalogue.QUERIES["oversized_chunks"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token_count), GreaterThan(token_count,150)]" in plan and "ReadSchema: struct<chunk_row:bigint,token_count:int>" in plan
