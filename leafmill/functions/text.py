"""Text expressions whose results equal Python's on code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space removed by Python's strip, as a string of characters.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(text: Column | str) -> Column:
    """Unicode white space removed at both ends."""
    return F.trim(_col(text), F.lit(WHITE_SPACE))


def canonical_type(kind: Column | str) -> Column:
    """Block types differ in letter case, outer blanks and '-' for '_'."""
    return F.lower(F.translate(py_strip(kind), "-", "_"))


def preview(text: Column | str, n: int) -> Column:
    """The first ``n`` code points with newlines as blanks."""
    return F.translate(F.substring(_col(text), 1, n), "\n", " ")


def breadcrumb(path: Column | str) -> Column:
    return F.array_join(F.coalesce(_col(path), F.array().cast("array<string>")), " > ")


def count_of(text: Column | str, part: str) -> Column:
    """How often ``part`` occurs, not overlapping."""
    text = _col(text)
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def number_level(text: Column | str) -> Column:
    """Level of a heading's section number (dots + 1), null without a number."""
    number = F.regexp_extract(_col(text), r"(?U)^\s*(\d+(?:\.\d+)*)\b", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def unix_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "\r\n?", "\n")
