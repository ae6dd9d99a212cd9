"""Embedding of texts through models that can be put in.

The default is signed feature hashing of lower-case words, scaled to length
1: deterministic and without files, but without a language model's sense of
meaning.
"""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.config import EmbeddingConfig


class Embedder(Protocol):
    dimension: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashEmbedder:
    def __init__(self, config: EmbeddingConfig = EmbeddingConfig()):
        self.config, self.dimension = config, config.dimension

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[k, (h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
        if self.config.normalise:
            n = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out = np.divide(out, n, out=out, where=n > 0)
        return out.astype(np.float32)

    def embed_query(self, text: str) -> list[float]:
        return [float(x) for x in self.embed_documents([text])[0]]


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int | None = None) -> DataFrame:
    """``key`` and ``vector`` of every row; the model is sent once and called with ``batch`` texts at a time, by default as its configuration says."""
    batch = batch or getattr(getattr(embedder, "config", None), "batch_size", EmbeddingConfig.batch_size)
    shared = df.sparkSession.sparkContext.broadcast(embedder)

    def run(batches):
        model = shared.value
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = model.embed_documents(part.column(1).to_pylist())
                offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * model.dimension)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), pa.float32()))], [key, "vector"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, vector array<float>")
