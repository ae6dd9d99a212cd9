"""Incremental ingestion: a stream of chunks into a vector collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.embed import Embedder, embed
from leafmill.operators.store import Store, last_wins, points


def ingest(chunks: DataFrame, store: Store, name: str, embedder: Embedder, metadata: list[str], checkpoint: str, once: bool = True, order: str | None = None) -> StreamingQuery:
    """Embed every micro-batch and upsert it; ids are deterministic, so a batch that runs twice changes nothing.

    Of equal ids in a batch the last by ``order`` wins, without it the greatest by content; a later batch wins over an earlier one."""
    store.create(name, embedder.dimension)

    def write(batch: DataFrame, _: int) -> None:
        distinct = last_wins(batch, "chunk_id", order) if order else last_wins(batch.withColumn("_order", F.struct(*batch.columns)), "chunk_id", "_order").drop("_order")
        vectors = embed(distinct, "chunk_id", "text", embedder)
        store.upsert(name, points(distinct.join(vectors, "chunk_id"), metadata))

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
