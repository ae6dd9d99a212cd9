"""Problem 2: filling containers of fixed capacity with the blocks of a document.

Method.  Items (an oversized block first becomes pieces within the capacity)
are placed best fit, largest first.  If that needs more bins than the sum of
sizes allows, local search takes the emptiest bin and moves items to any other
underfull bin or exchanges one for one, two for one or one for two, always
the step that raises the sum of squared fills most, until bins empty or no
step is left.  All underfull bins of a group take part.

A document of more than ``SHARD`` items is packed in groups of about so many.
As long as it has more bins than its size needs, its underfull bins are put
into new groups, in turn by their free room (the emptiest meet) and by a
salted hash (any may meet), and the search goes on from the bins there are.
A document is done when it has the least number of bins, when one group held
all its underfull bins, or when two rounds in a row emptied less than
``GAIN`` of its bins.  Groups are formed by the count of items, so none grows
with a document.

Cases: null and blank texts are no items; repeated rows are items of their
own; a null document is a document; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import cohesion
from leafmill.llm.sentences import Splitter
from leafmill.sources.tables import by_keys, cut

#: Items that are packed together, about.
SHARD = 2048
#: A document is opened again as long as a round empties this share of its bins.
GAIN = 0.001

#: Unicode white space, as in Python's strip.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, largest items first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(free, (sizes[k], -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(k)
            insort(free, (room - sizes[k], b))
        else:
            bins.append([k])
            insort(free, (capacity - sizes[k], len(bins) - 1))
    return bins


class Search:
    """Moves and exchanges between underfull bins.

    ``table`` lists what each underfull bin can give: nothing, one item or two,
    with their size; equal sizes of a bin are listed once.  A step that takes
    ``d`` > 0 from bin a to a bin b at least as full raises the sum of squared
    fills by 2d(fill b - fill a + d)."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.sizes, self.capacity, self.bins = sizes, capacity, [list(b) for b in bins]
        self.fill = np.array([sum(sizes[k] for k in b) for b in bins], dtype=np.int64)

    def _gifts(self, b: int) -> list[tuple[int, int, int]]:
        own, sizes = self.bins[b], self.sizes
        one, two = {}, {}
        for i, x in enumerate(own):
            one.setdefault(sizes[x], (sizes[x], x, -1))
            for y in own[i + 1 :]:
                both = sizes[x] + sizes[y]
                two.setdefault(both, (both, x, y))
        return [(0, -1, -1), *one.values(), *two.values()]

    def _lay_out(self) -> list[int]:
        """List what all underfull bins can give; returns these bins."""
        live = [b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.capacity]
        listed = [self._gifts(b) for b in live]
        ends = np.cumsum([0, *map(len, listed)])
        self.span = {b: (int(i), int(j)) for b, i, j in zip(live, ends, ends[1:])}
        self.n = n = int(ends[-1])
        self.table = np.zeros((2 * n + 64, 3), dtype=np.int64)
        self.home, self.level, self.room = (np.full(2 * n + 64, -1, dtype=np.int64) for _ in range(3))
        if n:
            self.table[:n] = [g for gifts in listed for g in gifts]
            self.home[:n] = np.repeat(live, np.diff(ends))
            self.level[:n] = self.fill[self.home[:n]]
            self.room[:n] = self.capacity - self.level[:n]
        return live

    def _again(self, b: int) -> None:
        """List a changed bin at the end of the table; its old rows have no room any more."""
        i, j = self.span.pop(b, (0, 0))
        self.room[i:j] = -1
        if not self.bins[b] or self.fill[b] == self.capacity:
            return
        gifts = self._gifts(b)
        i, j = self.n, self.n + len(gifts)
        if j > len(self.table):
            self._lay_out()
            return
        self.table[i:j], self.home[i:j], self.level[i:j], self.room[i:j] = gifts, b, self.fill[b], self.capacity - self.fill[b]
        self.span[b], self.n = (i, j), j

    def step(self, a: int) -> bool:
        """Take the best step out of bin ``a``, if there is one."""
        if a not in self.span:
            return False
        own, n = self.table[slice(*self.span[a])], self.n
        others = np.flatnonzero((self.room[:n] > 0) & (self.level[:n] >= self.fill[a]) & (self.home[:n] != a))
        if not len(others):
            return False
        table, room, ahead = self.table[others], self.room[others], self.level[others] - self.fill[a]
        best, step = 0, None
        for gives, fit in ((own[(own[:, 1] >= 0) & (own[:, 2] < 0)], True), (own[own[:, 2] >= 0], table[:, 2] < 0)):
            if len(gives):
                d = gives[:, :1] - table[:, 0]
                gain = np.where((d > 0) & (d <= room) & fit, d * (ahead + d), 0)
                at = int(gain.argmax())
                if gain.flat[at] > best:
                    g, t = divmod(at, len(others))
                    best, step = gain.flat[at], (gives[g, 1:], table[t, 1:], int(self.home[others[t]]))
        if step is None:
            return False
        out, into = ([int(k) for k in part if k >= 0] for part in step[:2])
        b = step[2]
        self.bins[a] = [k for k in self.bins[a] if k not in out] + into
        self.bins[b] = [k for k in self.bins[b] if k not in into] + out
        for changed in (a, b):
            self.fill[changed] = sum(self.sizes[k] for k in self.bins[changed])
        self._again(a)
        self._again(b)
        return True

    def run(self, least: int) -> list[list[int]]:
        """The bins when no step is left or there are no more than ``least``; every step raises the sum of squared fills, so it ends."""
        changed = True
        while changed and sum(map(bool, self.bins)) > least:
            changed = False
            for a in sorted(self._lay_out(), key=lambda b: self.fill[b]):
                while self.bins[a] and self.step(a):
                    changed = True
        return [b for b in self.bins if b]


def pack(sizes: list[int], capacity: int, given: list[list[int]] | None = None) -> list[list[int]]:
    """Bins of item numbers; no item may exceed the capacity. ``given``: bins to go on from; the better of these and of fresh ones is kept."""
    least = -(-sum(sizes) // capacity)
    if given is not None:
        given = Search(given, sizes, capacity).run(least) if len(given) > least else given
        if len(given) <= least:
            return given
    bins = best_fit(sizes, capacity)
    if len(bins) > least:
        bins = Search(bins, sizes, capacity).run(least)
    return given if given is not None and len(given) <= len(bins) else bins


_ITEMS = "document_id string, shard bigint, block_order int, block_row bigint, piece_no int, size int, bin string, shards bigint"
_PACKED = _ITEMS + ", fill int, head boolean"


def _groups(batches, width: int):
    """Rows of one (document_id, shard) after the other, from sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if rows:
                    yield rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield rows


def _packer(capacity: int, turn: int):
    names = [f.split()[0] for f in _PACKED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches):
        out: list[list] = [[] for _ in kinds]
        for rows in _groups(batches, 2):
            given: dict[str, list[int]] = {}
            for k, r in enumerate(rows):
                given.setdefault(r[6], []).append(k)
            bins = pack([r[5] for r in rows], capacity, None if None in given else list(given.values()))
            for number, b in enumerate(bins):
                members = sorted((rows[k] for k in b), key=lambda r: (r[2] is None, r[2] or 0, r[3] is None, r[3] or 0, r[4]))
                name, fill = f"{turn}.{rows[0][1]}.{number}", sum(r[5] for r in members)
                for k, r in enumerate(members):
                    for column, value in zip(out, (*r[:6], name, r[7], fill, k == 0)):
                        column.append(value)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                out = [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def _pack_groups(items: DataFrame, capacity: int, turn: int = 0) -> DataFrame:
    sorted_items = by_keys(items, "document_id", "shard").sortWithinPartitions("document_id", "shard", "block_order", "block_row", "piece_no")
    return sorted_items.select(*[f.split()[0] for f in _ITEMS.split(", ")]).mapInArrow(_packer(capacity, turn), _PACKED)


def items_of(blocks: DataFrame, capacity: int, splitter: Splitter) -> DataFrame:
    """The items of each document with their first group; groups are counted by sizes, before anything is split."""
    size = F.length(F.trim("text", F.lit(BLANKS)))
    sized = blocks.select(F.col("document_id").cast("string").alias("document_id"), F.col("block_order").cast("int").alias("block_order"), F.col("block_row").cast("bigint").alias("block_row"), size.alias("size"), "text").where("size > 0")
    counts = sized.groupBy("document_id").agg(F.ceil(F.sum(F.ceil(F.col("size") / capacity)) / SHARD).alias("shards")).where("shards > 1").withColumnRenamed("document_id", "d")
    whole = sized.where(F.col("size") <= capacity).select("document_id", "block_order", "block_row", F.lit(0).alias("piece_no"), "size")
    large = sized.where(F.col("size") > capacity)
    rows = large.select(F.lit("container").alias("target"), F.col("block_row").alias("row_id"), F.lit("text").alias("kind"), F.lit(capacity).alias("most"), F.lit(0).alias("overlap"), "text", "document_id", "block_order")
    cuts = cohesion.split_sizes(rows, splitter, "document_id", "block_order").select("document_id", "block_order", F.col("row_id").alias("block_row"), "piece_no", "size").where("size > 0")
    items = whole.unionByName(cuts)
    with_shards = items.join(counts, items.document_id.eqNullSafe(counts.d), "left")
    shard = F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("block_row", "piece_no"), F.col("shards")))
    return with_shards.select("document_id", shard.cast("bigint").alias("shard"), "block_order", "block_row", "piece_no", "size", F.lit(None).cast("string").alias("bin"), F.coalesce("shards", F.lit(1)).cast("bigint").alias("shards"))


def _regrouped(bins: DataFrame, turn: int) -> DataFrame:
    """Underfull bins in new groups of about ``SHARD`` items, whole bins each: by free room in odd turns, by a salted hash in even ones.

    A fill has at most as many values as the capacity, so that places in its order come from counts of items by value."""
    part = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if turn % 2:
        counts = bins.groupBy("document_id", "fill").agg(F.count("*").alias("here"))
        by = Window.partitionBy("document_id").orderBy("fill").rowsBetween(Window.unboundedPreceding, -1)
        places = counts.select(F.col("document_id").alias("d"), F.col("fill").alias("f"), "here", F.coalesce(F.sum("here").over(by), F.lit(0)).alias("before"))
        placed = bins.join(places, bins.document_id.eqNullSafe(places.d) & (bins.fill == places.f))
        return placed.withColumn("shard", F.floor((F.col("before") + part * F.col("here")) / SHARD).cast("bigint")).drop("d", "f", "here", "before")
    return bins.withColumn("shard", F.floor(part * F.col("shards")).cast("bigint"))


def packed(items: DataFrame, capacity: int) -> DataFrame:
    """Every item with its bin and the bin's fill."""
    done, turn, finished = cut(_pack_groups(items, capacity)), 0, []
    state = done.where("shards > 1").groupBy("document_id").agg(F.count_if("head").alias("bins"), F.sum("size").alias("size"), F.count_if(F.col("fill") < capacity).alias("open"))
    state = cut(state.withColumns({"before": F.col("bins"), "idle": F.lit(0), "held_all": F.lit(False)}))
    while True:
        going = state.where((F.col("bins") > F.ceil(F.col("size") / capacity)) & (F.col("idle") < 2) & ~F.col("held_all")).select(F.col("document_id").alias("d"), "open", "bins", "size", "idle")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, [*finished, done]).select("document_id", "block_order", "block_row", "piece_no", "size", "bin", "fill")
        turn += 1
        same = done.document_id.eqNullSafe(going.d)
        underfull = F.col("fill") < capacity
        several = F.col("shards") > 1
        finished.append(done.where(~several | ~underfull).unionByName(done.where(several & underfull).join(going, same, "left_anti")))
        again = done.where(several & underfull).drop("shards").join(going.select("d", F.ceil(F.col("open") / SHARD).alias("shards")), same).drop("d")
        # one group that holds all underfull bins of a document is marked by shards = 1 and isn't opened again
        done = cut(_pack_groups(_regrouped(again, turn), capacity, turn))
        stats = done.groupBy("document_id").agg(F.count_if("head").alias("live"), F.count_if(F.col("fill") < capacity).alias("open"), (F.max("shards") == 1).alias("held_all"))
        was = again.groupBy("document_id").agg(F.count_if("head").alias("was"))
        stats = stats.alias("s").join(was.alias("w"), F.col("s.document_id").eqNullSafe(F.col("w.document_id"))).select("s.*", "was")
        after = stats.join(going.drop("open"), stats.document_id.eqNullSafe(going.d))
        fewer = F.col("was") - F.col("live")
        state = cut(after.select("document_id", (F.col("bins") - fewer).alias("bins"), "size", "open", F.when(fewer < F.col("bins") * GAIN, F.col("idle") + 1).otherwise(0).alias("idle"), "held_all"))


def chunks(bins: DataFrame, capacity: int) -> DataFrame:
    """One row per container: its blocks in block_order, its size and free room."""
    members = F.array_sort(F.collect_list(F.struct("block_order", "block_row", "piece_no")))
    return (
        bins.groupBy("document_id", "bin")
        .agg(members.alias("m"), F.sum("size").cast("int").alias("size"), F.count("*").cast("int").alias("items"))
        .select("document_id", F.col("m")[0]["block_order"].alias("first_order"), "bin", F.col("m.block_row").alias("block_rows"), F.col("m.piece_no").alias("piece_nos"), "items", "size", (F.lit(capacity) - F.col("size")).alias("free"))
    )


def summary(chunk_rows: DataFrame, capacity: int) -> DataFrame:
    """Per document: containers, the least number that its size allows, and the free room."""
    return chunk_rows.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.ceil(F.sum("size") / capacity).alias("least_chunks"), F.sum("size").alias("size"), F.sum("free").alias("free")
    )


def capacity_of(limits: DataFrame) -> int:
    row = limits.where(F.col("target") == "container").select(F.max("max_chars")).first()
    if row is None or row[0] is None or row[0] < 1:
        raise ValueError("size_limits names no container capacity")
    return int(row[0])
