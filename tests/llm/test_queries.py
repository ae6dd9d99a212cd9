"""All queries of the subpackage over empty tables, and over tables with nulls everywhere and clashing columns."""

import os

import pytest
from pyspark.sql import functions as F

from leafmill.llm import catalogue, encode
from leafmill.sources.tables import table

NAMES = ("loaded_documents", "loaded_pages", "blocks", "chunks", "documents", "size_limits", "mix_targets", "lexicon")
CLASHING = ("window", "own", "page", "size", "key", "a", "b", "n", "bucket", "slice", "kind", "ids", "tokens", "end_char")


@pytest.fixture(scope="module")
def odd(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in NAMES:
        df = table(spark, tables, name).limit(400)
        if name in ("blocks", "chunks", "documents", "loaded_documents"):
            for k, c in enumerate(df.columns):
                df = df.withColumn(c, F.when(F.pmod(F.xxhash64(*df.columns), F.lit(29)) != k, F.col(c)))
            df = df.unionByName(df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
            for c in CLASHING:
                if c not in df.columns:
                    df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in NAMES:
        df = table(spark, tables, name)
        (df if name in ("size_limits", "mix_targets", "lexicon") else df.limit(0)).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_no_crash(spark, odd, empty, name, kind):
    if name[:2] in ("p6", "p7") and not os.path.exists(encode.VOCABULARY):
        pytest.skip("no vocabulary file")
    n = catalogue.QUERIES[name](spark, odd if kind == "odd" else empty).count()
    assert n > 0 if kind == "odd" or name in ("p7_shares", "p7_repeats") else n == 0


def test_columns_of_the_found_queries(spark, tables):
    want = {
        "p1_found": [("block_row", "bigint"), ("end_char", "int")],
        "p3_found": [("target", "string"), ("row_id", "bigint"), ("boundary", "string")],
        "p4_found": [("block_row", "bigint"), ("line_no", "int"), ("kind", "string")],
        "p5_found": [("row_a", "bigint"), ("row_b", "bigint")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        assert catalogue.QUERIES[name](spark, tables).dtypes == columns
