"""Deterministic keys of documents, chunks and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of URLs for name-based UUIDs (RFC 9562).
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_id(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def chunk_id(document_id: Column, page: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", document_id, page.cast("string"), text), 256)


def window_id(document_id: Column, index: Column) -> Column:
    """Key of a fixed-size window: at least four digits, more where needed."""
    return F.format_string("%s_chunk_%04d", document_id, index)


def uuid5(name: Column | str) -> Column:
    """Name-based UUID (version 5) in the name space of URLs."""
    name = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
