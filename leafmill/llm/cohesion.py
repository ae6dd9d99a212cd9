"""Problem 3: splitting oversized items at natural boundaries.

Method.  The gaps of a text are paragraph breaks, line breaks, ends of
sentences (prose only) and white space.  The text between paragraph, line and
sentence gaps is a row of units; a unit of more than ``UNIT`` words is divided
further.  Around every gap between units the words of the ``SIDE`` units
before and after it are compared in sliding blocks; the depth of the valley of
their similarity marks a change of topic.  Within the size window of a piece
the gap with the deepest valley is taken, to which the kind of gap and the
filled share of the window add a little (``WEIGHT``, ``FILLED``), so that
they decide where the valleys are alike; the next piece begins ``overlap``
code points before the cut.  A window without a gap between units is cut at
its last white space, one without white space at the limit.

``boundary`` is measured on the same gaps: the first of paragraph, line,
sentence (text and list_item) and word in which every unit, stripped, is
within the limit, or none.

Cases: null and blank texts and texts within their limit give no rows; a type
without a limit gives no rows; repeated rows each give their pieces; extra
columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.sentences import Splitter, canonical, trimmed

#: Units on either side of a gap whose words are compared, and the most words of a unit.
SIDE, UNIT = 4, 20
LEVELS = ("char", "word", "sentence", "line", "paragraph")
#: What a gap's kind adds to the depth of its valley (0 to 2), so that a gap within a sentence is taken only where the window has no other; and what a full window adds.
WEIGHT, FILLED = (0.0, -2.0, 0.4, 0.5, 0.6), 0.4
PARAGRAPH_GAP = regex.compile(r"\n(?:[ \t]*\n)+")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}\-]*|\p{Han}|\p{N}+")
GAP = regex.compile(r"[\s\x1c-\x1f]+")
PROSE = ("text", "list_item")


class Gaps:
    """Where a text may be cut: ``places`` (where the next unit begins) with their ``levels``, and the ends and starts of the units of each division."""

    def __init__(self, text: str, prose: bool, splitter: Splitter):
        self.text, self.prose = text, prose
        self.blanks = [m.span() for m in GAP.finditer(text)]
        self.breaks = [m.span() for m in PARAGRAPH_GAP.finditer(text)] if "\n" in text else []
        self.ends = splitter.ends(text) if prose else []
        level = {b: 3 if "\n" in text[a:b] else 1 for a, b in self.blanks}
        for _, at in self.breaks:
            while text[at : at + 1] in (" ", "\t"):
                at += 1
            level[at] = 4
        for e in self.ends:
            m = GAP.match(text, e)
            at = m.end() if m else e
            level[at] = max(level.get(at, 0), 2)
        self.places = sorted(p for p in level if 0 < p < len(text))
        self.levels = [level[p] for p in self.places]

    def _fit(self, between: list[tuple[int, int]], limit: int) -> bool:
        """Whether all units, stripped, between these gaps are within the limit."""
        starts, ends = [0, *(b for _, b in between)], [*(a for a, _ in between), len(self.text)]
        return all(b - a <= limit or len(self.text[a:b].strip()) <= limit for a, b in zip(starts, ends))

    def division(self, limit: int) -> str:
        """The first division whose units are all within the limit."""
        if self._fit(self.breaks, limit):
            return "paragraph"
        lines = [(k, k + 1) for a, b in self.blanks for k in range(a, b) if self.text[k] == "\n"]
        if self._fit(lines, limit):
            return "line"
        if self.prose and self._fit([(e, e) for e in self.ends], limit):
            return "sentence"
        return "word" if self._fit(self.blanks, limit) else "none"


def depths(text: str, places: list[int], levels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the places between units, and the depth of the similarity valley at each.

    Products of the word counts of units up to 2 * SIDE apart are summed over the two blocks, so the work is linear in the text."""
    words = [m.start() for m in WORD.finditer(text)]
    bounds = np.array(places, dtype=np.int64)
    seen = np.searchsorted(np.array(words, dtype=np.int64), bounds)
    chosen, last = [], 0
    strong = np.flatnonzero(np.array(levels) >= 2).tolist() + [len(places)]
    begin = 0
    for s in strong:
        # the words of a long unit are divided at every UNIT-th
        stop = seen[s] if s < len(places) else len(words)
        k = begin
        while stop - last > UNIT:
            k = max(k, int(np.searchsorted(seen, last + UNIT, "left")))
            if k >= s:
                break
            chosen.append(k)
            last = seen[k]
        if s < len(places):
            chosen.append(s)
            begin, last = s + 1, seen[s]
    at = np.array(chosen, dtype=np.int64)
    n = len(at)
    if not n:
        return at, np.zeros(0)
    numbers: dict[str, int] = {}
    word = np.array([numbers.setdefault(m[0].lower(), len(numbers)) for m in WORD.finditer(text)], dtype=np.int64)
    unit = np.searchsorted(bounds[at], np.array(words, dtype=np.int64), "right")
    size = len(numbers) + 1
    keys, counts = np.unique(unit * size + word, return_counts=True)
    products = np.zeros((2 * SIDE, n + 1))  # products[g, u]: unit u times unit u + g
    for g in range(2 * SIDE):
        found = np.searchsorted(keys, keys + g * size)
        found[found == len(keys)] = 0
        same = keys[found] == keys + g * size if len(keys) else np.zeros(0, dtype=bool)
        products[g] = np.bincount(keys[same] // size, weights=counts[same] * counts[found[same]], minlength=n + 1)[: n + 1]
    padded = np.pad(products, ((0, 0), (2 * SIDE, 2 * SIDE)))
    k = np.arange(n) + 2 * SIDE  # unit k is the last before gap k
    left, right, both = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(SIDE):
        for j in range(SIDE):
            both += padded[i + j + 1, k - i]
            left += padded[abs(i - j), k - max(i, j)]
            right += padded[abs(i - j), k + 1 + min(i, j)]
    norm = np.sqrt(left * right)
    similar = np.divide(both, norm, out=np.zeros(n), where=norm > 0)
    # the peak that the curve climbs to without a fall, on either side
    before, after = similar.copy(), similar.copy()
    for x in range(1, n):
        if similar[x - 1] >= similar[x]:
            before[x] = before[x - 1]
    for x in range(n - 2, -1, -1):
        if similar[x + 1] >= similar[x]:
            after[x] = after[x + 1]
    return at, np.maximum(0.0, before + after - 2 * similar)


def pieces(gaps: Gaps, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut at the end) of pieces that cover the text; each within the limit when stripped."""
    text, places, levels = gaps.text, gaps.places, gaps.levels
    stop = len(text.rstrip())
    start = len(text) - len(text.lstrip())
    units, depth = depths(text, places, levels)
    depth = depth + np.array(WEIGHT)[np.array(levels, dtype=np.int64)[units]]
    # a place is after white space; a piece that is cut there ends before it
    ends = [trimmed(text, p) for p in places]
    unit_ends = np.array([ends[k] for k in units.tolist()], dtype=np.int64)
    out: list[tuple[int, int, str]] = []
    overlap = max(0, min(overlap, limit - 1))
    while True:
        # white space at the start of a piece doesn't count against the limit
        lead = start
        while lead < stop and text[lead].isspace():
            lead += 1
        if stop - lead <= limit:
            out.append((start, stop, "end"))
            return out
        most = lead + limit
        passed = out[-1][1] if out else start
        low, high = np.searchsorted(unit_ends, passed, "right"), np.searchsorted(unit_ends, most, "right")
        if low < high:
            score = depth[low:high] + FILLED * (unit_ends[low:high] - lead) / limit
            best = int(units[low + len(score) - 1 - int(score[::-1].argmax())])
            cut, end, kind = places[best], ends[best], LEVELS[levels[best]]
        elif (last := bisect_right(ends, most) - 1) >= 0 and ends[last] > passed:
            cut, end, kind = places[last], ends[last], "word"
        else:
            cut = end = most
            kind = "char"
        out.append((start, end, kind))
        start = max(end - overlap if overlap else cut, start + 1)


_PIECES = "target string, row_id bigint, boundary string, piece_no int, start_char int, end_char int, cut string, size int, piece string"


def oversized(df: DataFrame, target: str, key: str, kind: str, text: str, limits: DataFrame, *keep: str) -> DataFrame:
    """Rows that may be too large, with their limit; the exact test is on the stripped text."""
    own = limits.where(F.col("target") == target).select(F.col("kind").alias("k"), F.col("max_chars").alias("most"), F.col("overlap_chars").alias("overlap"))
    rows = df.select(F.lit(target).alias("target"), F.col(key).cast("bigint").alias("row_id"), canonical(kind).alias("kind"), F.col(text).alias("text"), *keep)
    return rows.join(F.broadcast(own), F.col("kind") == F.col("k")).where(F.length("text") > F.col("most")).select("target", "row_id", "kind", "most", "overlap", "text", *keep)


def _each(batches, splitter: Splitter):
    """(row, boundary, pieces) of every item over its limit."""
    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            _, _, kind, most, overlap, text, *_ = row
            if len(text.strip()) > most:
                gaps = Gaps(text, kind in PROSE, splitter)
                rows.append((row, gaps.division(most), pieces(gaps, most, overlap or 0)))
        yield rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def split_oversized(rows: DataFrame, splitter: Splitter) -> DataFrame:
    """One row per piece of the items of ``oversized``."""
    shared = rows.sparkSession.sparkContext.broadcast(splitter)
    kinds = dict(string=pa.string(), bigint=pa.int64(), int=pa.int32())
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in _PIECES.split(", "))])

    def run(batches):
        for items in _each(batches, shared.value):
            yield _batch([(r[0], r[1], boundary, no, a, b, cut, len(r[5][a:b].strip()), r[5][a:b]) for r, boundary, found in items for no, (a, b, cut) in enumerate(found)], schema)

    return rows.mapInArrow(run, _PIECES)


def divisions(rows: DataFrame, splitter: Splitter) -> DataFrame:
    """One row per item of ``oversized``: its boundary and the number of its pieces, found as by ``split_oversized``, without the texts of the pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(splitter)
    schema = pa.schema([("target", pa.string()), ("row_id", pa.int64()), ("boundary", pa.string()), ("pieces", pa.int32())])

    def run(batches):
        for items in _each(batches, shared.value):
            yield _batch([(r[0], r[1], boundary, len(found)) for r, boundary, found in items], schema)

    return rows.mapInArrow(run, "target string, row_id bigint, boundary string, pieces int")


def split_sizes(rows: DataFrame, splitter: Splitter, *keep: str) -> DataFrame:
    """The sizes of the pieces of the items of ``oversized``, with further columns of these (strings and ints), without the texts."""
    shared = rows.sparkSession.sparkContext.broadcast(splitter)
    kinds = dict(string=pa.string(), bigint=pa.int64(), int=pa.int32())
    kept = [(c, rows.schema[c].dataType.simpleString()) for c in keep]
    schema = pa.schema([("row_id", pa.int64()), ("piece_no", pa.int32()), ("size", pa.int32()), *((c, kinds[kind]) for c, kind in kept)])

    def run(batches):
        for items in _each(batches, shared.value):
            yield _batch([(r[1], no, len(r[5][a:b].strip()), *r[6:]) for r, _, found in items for no, (a, b, _) in enumerate(found)], schema)

    return rows.select("target", "row_id", "kind", "most", "overlap", "text", *keep).mapInArrow(run, ", ".join(["row_id bigint, piece_no int, size int", *(f"`{c}` {kind}" for c, kind in kept)]))
