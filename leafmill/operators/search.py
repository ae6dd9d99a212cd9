"""Exact similarity search.

A set of queries is met with all points in blocks: ``BLOCK`` queries at a
time are a matrix that is sent to the executors; a task scores its points
against it and keeps the best k of each query over all of its batches, so that
k rows a task and query are shuffled, however many points there are.

Vectors of another length than the queries' have no similarity to them and are
left out, as are null vectors; query vectors of several lengths are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.functions.vectors import cosine

#: Query vectors sent at once (of 768 doubles: 50 MB).
BLOCK = 8192
#: Scores computed at once in a task (of doubles: 32 MB).
SCORES = 4_000_000


def scores(points: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """Points with their cosine similarity to one query vector."""
    return points.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def top_k(points: DataFrame, query: list[float], k: int = 5, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k most similar points, ties by key, with rank from 1."""
    best = scores(points, query, vector).orderBy(F.desc("score"), F.asc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), F.asc(key))))


def _matrix(column) -> np.ndarray:
    """Vectors of a list column as rows of unit length; zero vectors stay zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _local_best(names, block, k: int | None, kinds, key_kind):
    def emit(ids, queries, keys, values):
        return pa.RecordBatch.from_arrays([pa.array(ids, kinds).take(pa.array(queries)), pa.array(keys, key_kind) if isinstance(keys, list) else keys, pa.array(values)], names)

    def run(batches):
        ids, matrix = block.value
        best = (np.zeros(0, np.int64), [], np.zeros(0))  # queries, keys and scores of the best so far
        edge = np.full(len(ids), -np.inf)
        rows = max(1, SCORES // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                scores = _matrix(part.column(1)) @ matrix.T
                if k is None:
                    points, queries = np.divmod(np.arange(scores.size), len(ids))
                    yield emit(ids, queries, part.column(0).take(pa.array(points)), scores.ravel())
                    continue
                # what isn't below the k-th best of the part or so far; equal scores are ordered by key
                m = min(k, len(scores))
                bound = np.maximum(edge, -np.partition(-scores, m - 1, axis=0)[m - 1])
                points, queries = np.nonzero(scores >= bound)
                queries = np.concatenate([best[0], queries])
                values = np.concatenate([best[2], scores[scores >= bound]])
                keys = best[1] + part.column(0).take(pa.array(points)).to_pylist()
                order = np.array(sorted(range(len(keys)), key=lambda i: (queries[i], -values[i], keys[i])), dtype=np.int64)
                place = np.arange(len(order)) - np.searchsorted(queries[order], queries[order], "left")
                order = order[place < k]
                best = queries[order], [keys[i] for i in order.tolist()], values[order]
                full = np.flatnonzero(place[place < k] == k - 1)
                edge[best[0][full]] = best[2][full]
        if k is not None:
            yield emit(ids, *best)

    return run


def _blocks(queries: DataFrame, query_key: str, vector: str):
    """The query set in blocks of bounded size, one after the other."""
    ids, vectors = [], []
    for r in queries.select(query_key, vector).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == BLOCK:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors


def score_set(points: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str, k: int | None = None) -> DataFrame:
    """``query_id``, ``key``, ``score`` of all pairs, or of each task's best k per query."""
    sc = points.sparkSession.sparkContext
    kind, query_kind = points.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    whole = points.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    key_kind, query_key_kind = to_arrow_type(points.schema[key].dataType), to_arrow_type(queries.schema[query_key].dataType)
    out = length = None
    for ids, vectors in _blocks(queries.where(F.col(vector).isNotNull()), query_key, vector):
        length = len(vectors[0]) if length is None else length
        if any(len(v) != length for v in vectors):
            raise ValueError("query vectors differ in length")
        m = np.array(vectors, dtype=np.float64)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        block = sc.broadcast((ids, np.divide(m, n, out=np.zeros_like(m), where=n > 0)))
        part = whole.where(F.size(vector) == length).mapInArrow(_local_best(["query_id", key, "score"], block, k, query_key_kind, key_kind), f"query_id {query_kind}, `{key}` {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return points.sparkSession.createDataFrame([], f"query_id {query_kind}, `{key}` {kind}, score double")
    return out


def top_k_set(points: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str) -> DataFrame:
    """The k most similar points of each query, ties by key, with rank from 1."""
    near = score_set(points, queries, key, query_key, vector, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
