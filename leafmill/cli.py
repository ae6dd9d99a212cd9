"""Ask questions of a collection from a terminal: python -m leafmill.cli STORE COLLECTION."""

from __future__ import annotations

import sys
from collections.abc import Callable

from leafmill.operators import qa


def converse(answer: Callable[[str], dict], read: Callable[[], str], write: Callable[[str], None]) -> None:
    """Read questions until 'quit' or the end; blank ones are skipped, an error is told and the talk goes on."""
    while True:
        try:
            question = read().strip()
        except EOFError:
            return
        if question.lower() == "quit":
            return
        if not question:
            continue
        try:
            got = answer(question)
        except Exception as e:
            write(f"Error: {e}")
            continue
        write(got["answer"])
        for k, (source, score) in enumerate(zip(got["sources"], got["scores"]), 1):
            write(f"[{k}] {source} (similarity: {score:.4f})")


def main(argv: list[str]) -> int:
    if len(argv) != 2:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from leafmill.config import EmbeddingConfig
    from leafmill.operators.embed import HashEmbedder
    from leafmill.operators.store import Store

    store, name = Store(SparkSession.builder.getOrCreate(), argv[0]), argv[1]
    meta = store.meta(name)
    if meta is None or store.read(name).isEmpty():
        print(f"Collection {name} has no points.")
        return 1
    embedder = HashEmbedder(EmbeddingConfig(dimension=meta["size"]))
    converse(lambda q: qa.ask(store, name, embedder, q), lambda: input("> "), print)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
