"""leafmill: document ingestion, chunking and vector retrieval as Spark jobs."""

__version__ = "0.1.0"
