"""Problem 5: groups of records that share most of their content.

Similarity is that of the sets of all substrings of ``GRAM`` code points of
the normalised texts (lower case, runs of Unicode white space as one blank,
stripped), intersection over union.

Method.  Equal normalised texts are one text; the rest works on distinct
texts.  Each text gets ``BANDS * ROWS`` min-hashes, whose bands name the
candidates, and ``CHECKS`` further min-hashes of one byte each.  Candidates
are verified in sequence: after every ``BATCH`` bytes the number of agreeing
bytes bounds the posterior of the similarity under a uniform prior, and a
pair is dropped once the probability that it reaches the threshold is below
``MISS``.  Survivors are compared exactly.  Buckets of a band of more than
``FEW`` texts are compared in blocks: each pair of blocks goes to its own
group, where signatures are compared as arrays and only survivors are
emitted, so a hot bucket is neither one task nor a list of all its pairs.  A
bucket of n texts is shuffled n / ``BLOCK`` times (of 100,000 texts 196 times
its 80 bytes a text).  Rows of equal texts are listed block by block as well.

Cases: null texts, rows without a key and texts of fewer than ``MIN_CHARS`` code points after
normalisation are left out; repeated rows are pairs under their own keys;
columns other than the named ones are not read; an empty table gives an
empty result; texts of any length are read whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.tables import cut

GRAM, MIN_CHARS, THRESHOLD = 5, 100, 0.7
BANDS, ROWS = 36, 6
CHECKS, BATCH, MISS = 64, 16, 1e-4
#: Buckets of up to FEW texts list their pairs; larger ones are compared in blocks of BLOCK texts inside tasks.
FEW, BLOCK = 16, 512
#: Keys of 16 bytes that are sent to every executor at most (16 MB, about 60 MB as a hash table); beyond it a join shuffles.
KEYS_SENT = 1_000_000


def normalised(text: str) -> str:
    """The text as it is compared."""
    return " ".join(text.lower().split())


@functools.lru_cache(maxsize=1)
def _multipliers(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return (draw.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1).astype(np.uint32), draw.integers(0, 2**32, n, dtype=np.uint32)


def grams(text: str) -> np.ndarray:
    """A 64-bit hash of every substring of GRAM code points."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = points[:n].copy()
    for k in range(1, GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += points[k : n + k]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of the set, band hashes (int64) and check bytes of each text."""
    total = BANDS * ROWS + CHECKS
    a, b = _multipliers(total)
    hashes = [np.unique((grams(t) >> np.uint64(7)).astype(np.uint32)) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(hashes)
    out = np.empty((total, len(texts)), dtype=np.uint32)
    work = np.empty_like(flat)
    for k in range(total):
        np.multiply(flat, a[k], out=work)
        work += b[k]
        out[k] = np.minimum.reduceat(work, starts)
    mixed = out[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS, len(texts))
    band = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    band = np.broadcast_to(band, (BANDS, len(texts))).copy()
    for r in range(ROWS):
        band ^= mixed[:, r]
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(32)
    checks = out[BANDS * ROWS :]
    checks = ((checks * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
    return sizes, np.ascontiguousarray(band.T).view(np.int64), np.ascontiguousarray(checks.T)


@functools.lru_cache(maxsize=4)
def least_agreeing(threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest agreeing bytes with P(similarity >= threshold | agreeing) >= miss.

    Bytes agree with probability s + (1 - s) / 256; the prior of s is uniform."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, CHECKS + 1, BATCH):
        least = n
        for m in range(n, -1, -1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(logs - logs.max())
            if weight[s >= threshold].sum() / weight.sum() < miss:
                break
            least = m
        out.append(least)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sequential verification of pairs of check bytes: which pairs stay."""
    live = np.arange(len(a))
    agree = np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(least_agreeing()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree[live] += (a[live, part] == b[live, part]).sum(axis=1, dtype=np.int32)
        live = live[agree[live] >= least]
        if not len(live):
            break
    return live


_SIGNED = "key bigint, text_id bigint, size int, bands array<bigint>, checks binary"


def _sign(batches):
    """Signatures of the rows that count; copies within a batch are signed once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keys, texts, place, where = [], [], {}, []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                norm = normalised(text)
                if len(norm) >= MIN_CHARS:
                    keys.append(key)
                    where.append(place.setdefault(norm, len(place)))
            if not keys:
                continue
            texts = list(place)
            sizes, bands, checks = signatures(texts)
            ids = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
            where = np.array(where)
            n, raw = len(keys), checks[where].tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands[where].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids[where]), pa.array(sizes[where], pa.int32()), lists, pa.array([raw[k * CHECKS : (k + 1) * CHECKS] for k in range(n)], pa.binary())],
                ["key", "text_id", "size", "bands", "checks"],
            )


def signed_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text_id`` (a 64-bit hash of the normalised text) and signature of the rows that count, written once."""
    return cut(df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").mapInArrow(_sign, _SIGNED))


def _small(df: DataFrame) -> DataFrame:
    """``df``, sent to every executor where its size allows."""
    return F.broadcast(df) if df.limit(KEYS_SENT + 1).count() <= KEYS_SENT else df


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, CHECKS)


def _check_pairs(batches):
    """Sequential verification of candidate rows (a, b, checks_a, checks_b)."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, CHECKS) for k in (2, 3))
            yield batch.select([0, 1]).take(pa.array(plausible(a, b)))


def _check_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of a hot bucket against each other (or one against itself)."""
    left = pdf[pdf.block == pdf.i.iloc[0]]
    right = pdf[pdf.block == pdf.j.iloc[0]]
    ids_a, ids_b = left.text_id.to_numpy(), right.text_id.to_numpy()
    sigs_a, sigs_b = _bytes(left.checks), _bytes(right.checks)
    out_a, out_b = [], []
    for k in range(len(ids_a)):
        kept = plausible(np.broadcast_to(sigs_a[k], sigs_b.shape), sigs_b)
        kept = kept[ids_b[kept] != ids_a[k]]
        out_a.append(np.minimum(ids_a[k], ids_b[kept]))
        out_b.append(np.maximum(ids_a[k], ids_b[kept]))
    return pd.DataFrame({"a": np.concatenate(out_a) if out_a else [], "b": np.concatenate(out_b) if out_b else []}).astype("int64")


def _similar(batches):
    """Exact similarity of rows (a, b, text_a, text_b)."""
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        memory: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            if t not in memory:
                memory[t] = np.unique(grams(normalised(t)))
            return memory[t]

        values = np.empty(len(a))
        for k in range(len(a)):
            x, y = of(a[k]), of(b[k])
            common = len(np.intersect1d(x, y, assume_unique=True))
            values[k] = common / max(1, len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["a", "b", "similarity"])


def similar_texts(signed: DataFrame, df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of distinct texts at the threshold or above, with their similarity.

    ``signed``: the rows of ``signed_rows``; ``df`` holds their texts, which are read again for the survivors only."""
    first = signed.groupBy("text_id").agg(F.min("key").alias("first"))
    copies = cut(signed.select("key", "text_id").join(first, "text_id").where("key <> first").select("key"))
    texts = signed.join(_small(copies), "key", "left_anti")
    buckets = texts.select("text_id", F.explode("bands").alias("bucket"))
    shared = cut(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    crowded = buckets.join(_small(shared), "bucket")
    few = crowded.where(F.col("n") <= FEW).select("bucket", "text_id")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.text_id") < F.col("y.text_id"))).select(F.col("x.text_id").alias("a"), F.col("y.text_id").alias("b")).distinct()
    checks = texts.select("text_id", "checks", "size")
    left = checks.select(F.col("text_id").alias("a"), F.col("checks").alias("checks_a"), F.col("size").alias("size_a"))
    right = checks.select(F.col("text_id").alias("b"), F.col("checks").alias("checks_b"), F.col("size").alias("size_b"))
    near = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold - 0.01)
    checked = pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "checks_a", "checks_b").mapInArrow(_check_pairs, "a bigint, b bigint")
    placed = crowded.where(F.col("n") > FEW).join(checks, "text_id").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
    others = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(block, o) as i, greatest(block, o) as j))")
    spread = placed.select("bucket", "text_id", "checks", "block", F.explode(others).alias("pair")).select("bucket", "text_id", "checks", "block", "pair.i", "pair.j")
    in_blocks = spread.groupBy("bucket", "i", "j").applyInPandas(_check_blocks, "a bigint, b bigint")
    survivors = cut(checked.unionByName(in_blocks).distinct())
    needed = survivors.select(F.explode(F.array("a", "b")).alias("text_id")).distinct()
    needed = cut(first.join(needed, "text_id").select("text_id", F.col("first").alias("key")))
    whole = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).join(_small(needed), "key").select("text_id", "text")
    left = whole.select(F.col("text_id").alias("a"), F.col("text").alias("text_a"))
    right = whole.select(F.col("text_id").alias("b"), F.col("text").alias("text_b"))
    exact = survivors.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a bigint, b bigint, similarity double")
    return exact.where(F.col("similarity") >= threshold)


def _member_blocks(signed: DataFrame) -> DataFrame:
    """The keys of each text in blocks of about ``BLOCK``: ``text_id``, ``block``, ``blocks``, ``keys``.

    A text of many copies is many rows of bounded size; keys are put together by a hash of their own before they are shuffled by text."""
    counts = signed.groupBy("text_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    large = counts.where("blocks > 1")
    placed = signed.select("key", "text_id").join(_small(large), "text_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    return placed.groupBy("text_id", "block").agg(F.any_value("blocks").alias("blocks"), F.collect_list("key").alias("keys"))


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of rows (row_a < row_b) whose texts are similar, copies included.

    Pairs of texts, and each text with itself, become pairs of blocks of their rows, which are spread before they are listed: no task lists more than ``BLOCK`` rows against ``BLOCK`` rows (about) at a time."""
    signed = signed_rows(df, key, text)
    links = cut(similar_texts(signed, df, key, text, threshold))
    members = cut(_member_blocks(signed))
    sizes = members.groupBy("text_id").agg(F.any_value("blocks").alias("blocks"), F.sum(F.size("keys")).alias("n"))
    a, b = (sizes.select(F.col("text_id").alias(s), F.col("blocks").alias(f"blocks_{s}")) for s in "ab")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = links.select("a", "b").join(a, "a").join(b, "b").select("a", "b", F.explode(every("blocks_a")).alias("i"), "blocks_b").select("a", "b", "i", F.explode(every("blocks_b")).alias("j"))
    same = sizes.where("n > 1").select(F.col("text_id").alias("a"), F.col("text_id").alias("b"), "blocks", F.explode(every("blocks")).alias("i")).select("a", "b", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
    cells = across.unionByName(same)
    x, y = (members.select(F.col("text_id").alias(s), F.col("block").alias(k), F.col("keys").alias(f"keys_{s}")) for s, k in ("ai", "bj"))
    listed = cells.join(x, ["a", "i"]).join(y, ["b", "j"]).select((F.col("a") == F.col("b")).alias("own"), (F.col("i") == F.col("j")).alias("diagonal"), "keys_b", F.explode("keys_a").alias("p"))
    pairs = listed.select("own", "diagonal", "p", F.explode("keys_b").alias("q")).where(~(F.col("own") & F.col("diagonal")) | (F.col("p") < F.col("q")))
    return pairs.select(F.least("p", "q").alias("row_a"), F.greatest("p", "q").alias("row_b"))


def groups(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row per counted record: ``key``, ``group_id`` (least key of its connected records), ``links`` (similar other texts of its text)."""
    rows = signed_rows(df, key, text)
    pairs = cut(similar_texts(rows, df, key, text, threshold).select("a", "b"))
    links = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("text_id"), F.least("a", "least").alias("group_id"))
    label = cut(label)
    # each round also follows the pointer to the label of the label, so the rounds are logarithmic in a chain's length
    while True:
        around = links.join(label, links.b == label.text_id).groupBy("a").agg(F.min("group_id").alias("near"))
        jump = label.select(F.col("text_id").alias("at"), F.col("group_id").alias("far"))
        new = label.join(around, label.text_id == around.a).select("text_id", F.least("group_id", "near").alias("g"), F.col("group_id").alias("old"))
        new = cut(new.join(jump, F.col("g") == F.col("at"), "left").select("text_id", F.least("g", F.coalesce("far", "g")).alias("group_id"), "old"))
        label = new.select("text_id", "group_id")
        if new.where("group_id <> old").isEmpty():
            break
    degree = links.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "text_id")
    labelled = (
        rows.select("key", "text_id")
        .join(label, "text_id", "left")
        .join(degree, "text_id", "left")
        .select("key", F.coalesce("group_id", "text_id").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    first = labelled.groupBy("g").agg(F.min("key").alias("group_id"))
    return labelled.join(first, "g").select(F.col("key").alias(key), "group_id", "links")
