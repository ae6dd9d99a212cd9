"""Problem 6: ids of a public byte-level BPE tokenizer for every text.

Method (speculate and verify).  The text is split by the tokenizer's own
pattern.  For each distinct word a greedy longest match proposes tokens.  All
adjacent pairs of all proposals are then tested together: a pair (a, b) is
compatible when byte-pair merging of its joined bytes would again end in
(a, b).  A sequence whose adjacent pairs are all compatible is the merge
result, so only words with a failing pair are merged exactly, by rank.

Cases: a null and an empty text give the empty list; strings that look like
special tokens are ordinary text; repeated rows each get their ids; columns of
the input other than the named ones are not read, so clashing names are
harmless.  Texts of any length are handled, one word being the longest unit
of exact merging.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("LEAFMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Words kept in a worker's table; beyond this it is emptied and refilled.
WORDS_KEPT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Vocabulary tables and the memory of words already encoded."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.split = regex.compile(PATTERN)
        self._halves()
        self._forget()

    def _halves(self) -> None:
        """left/right: the last merge that makes each token (itself if none);
        pair_ids: sorted codes of all pairs that merge, with the product."""
        ranks = self.ranks
        size = max(ranks.values()) + 1
        self.base = size
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        codes, made = [], []
        for token, rank in ranks.items():
            best = None
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is None or b is None:
                    continue
                codes.append(a * size + b)
                made.append(rank)
                # both halves exist before the token does; the merge order decides between several cuts
                if a < rank and b < rank and best is None:
                    if self._merged(token[:cut]) == [a] and self._merged(token[cut:]) == [b]:
                        whole = self._merged(token, below=rank)
                        if whole == [a, b]:
                            best = (a, b)
            if best:
                self.left[rank], self.right[rank] = best
        order = np.argsort(np.array(codes, dtype=np.int64))
        self.codes = np.array(codes, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]

    def _merged(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact byte-pair merging of one word, lowest rank first."""
        ranks = self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self._merged_long(word)
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merged_long(self, word: bytes) -> list[int]:
        """The same for long words, with a heap over a linked list."""
        import heapq

        ranks, n = self.ranks, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue
            if ranks.get(part[i] + part[j]) != _:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(part[k]) + len(part[after[k]])))
        return [ranks[p] for p in part if p is not None]

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.fresh: list[str] = []
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def _propose(self, word: bytes) -> list[int]:
        ranks, out, i, n = self.ranks, [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (r := ranks.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether merging the joined bytes ends in that pair.

        The last merges of both tokens are undone, the later one first.  At
        each step a merge across the seam that comes before the merge undone
        last would have taken its bytes, so the pair can't stand."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        x, y = a.copy(), b.copy()
        while len(live):
            at = np.searchsorted(self.codes, x * self.base + y)
            at[at == len(self.codes)] = 0
            hit = self.codes[at] == x * self.base + y
            bad = hit & (self.made[at] < limit)
            good[live[bad]] = False
            split_x, split_y = self.right[x] != x, self.left[y] != y
            # undo the later merge; of equal ids the left one was made first, so the right is undone
            undo_x = split_x & (~split_y | (x > y))
            undo_y = split_y & ~undo_x
            limit = np.where(undo_x, x, np.where(undo_y, y + 1, limit))
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            keep = ~bad & (undo_x | undo_y)
            live, x, y, limit = live[keep], x[keep], y[keep], limit[keep]
        return good

    def _learn(self) -> None:
        """Encode the words seen for the first time."""
        words = [w.encode() for w in self.fresh]
        self.fresh = []
        proposed = [self._propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            pairs = flat[inner] * self.base + flat[inner + 1]
            distinct, back = np.unique(pairs, return_inverse=True)
            fine = self.compatible(distinct // self.base, distinct % self.base)[back]
            wrong = np.unique(owner[inner[~fine]])
            for k in wrong:
                proposed[k] = self._merged(words[k])
            if len(wrong):
                sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
                flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word of all texts, and the words per text."""
        if len(self.index) > WORDS_KEPT:
            self._forget()
        index, fresh, split = self.index, self.fresh, self.split.findall
        known = len(index)
        numbers: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                found = split(text)
                counts[k] = len(found)
                try:
                    numbers.extend(map(index.__getitem__, found))
                except KeyError:
                    del numbers[int(counts[:k].sum()) :]
                    for w in found:
                        if w not in index:
                            index[w] = known + len(fresh)
                            fresh.append(w)
                    numbers.extend(map(index.__getitem__, found))
        if fresh:
            self._learn()
        return np.array(numbers, dtype=np.int64), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each."""
        numbers, counts = self.words(texts)
        first, size = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - first, size)
        text_ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[place], ends[text_ends]

    def count(self, texts: list[str | None]) -> np.ndarray:
        numbers, counts = self.words(texts)
        size = np.concatenate([[0], np.cumsum(self.start[numbers + 1] - self.start[numbers])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return size[ends[1:]] - size[ends[:-1]]


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and broadcast vocabulary."""
    if shared.key not in _encoders:
        _encoders.clear()
        _encoders[shared.key] = shared.ranks_broadcast.value
    return _encoders[shared.key]


class _Shared:
    """The encoder tables as a broadcast (a fixed vocabulary: bounded)."""

    def __init__(self, spark, path: str):
        self.ranks_broadcast = spark.sparkContext.broadcast(Encoder(read_ranks(path)))
        self.key = path


def _texts(batch: pa.RecordBatch, step: int = 1 << 22):
    """Slices of a batch whose texts stay under about ``step`` bytes."""
    texts = batch.column(1)
    size = max(1, batch.num_rows)
    rows = max(1, int(size * step / max(1, texts.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array of int) for every row of ``df``."""
    shared = _Shared(df.sparkSession, vocabulary or VOCABULARY)

    def run(batches):
        own = _encoder(shared)
        for batch in batches:
            for part in _texts(batch):
                flat, offsets = own.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (BIGINT), the length of the ids."""
    shared = _Shared(df.sparkSession, vocabulary or VOCABULARY)

    def run(batches):
        own = _encoder(shared)
        for batch in batches:
            for part in _texts(batch.select([batch.num_columns - 1] * 2 + list(range(batch.num_columns - 1)))):
                tokens = own.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(tokens, pa.int64())], [*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string")).mapInArrow(run, f"{kinds}, tokens bigint")
