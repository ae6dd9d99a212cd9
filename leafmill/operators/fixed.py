"""Windows of a fixed number of code points with overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.ids import window_id
from leafmill.functions.text import py_strip


def fixed_chunks(documents: DataFrame, size: int = 1000, overlap: int = 200, key: str = "document_id", text: str = "text") -> DataFrame:
    """Windows that start every size - overlap code points while text is left; blank texts give none."""
    if size <= 0:
        raise ValueError("a window needs at least one code point")
    if overlap < 0:
        raise ValueError("the overlap is negative")
    if overlap >= size:
        raise ValueError("the overlap has to be shorter than the window")
    step = size - overlap
    rows = documents.where(py_strip(text) != "").select(F.col(key), F.col(text), F.length(text).alias("n"), F.ceil(F.length(text) / step).cast("int").alias("total_chunks"))
    starts = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return starts.select(
        window_id(F.col(key).cast("string"), F.col("chunk_index")).alias("chunk_id"), key, F.substring(F.col(text), start + 1, F.lit(size)).alias("text"), "chunk_index", start.alias("start_char"),
        F.least(start + size, F.col("n")).alias("end_char"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap"), "total_chunks",
        F.lit("fixed").alias("strategy"), F.lit("fixed").alias("chunking_strategy"), F.lit(None).cast("int").alias("page_number"),
    )
