"""Settings."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EmbeddingConfig:
    model: str = "feature-hash"
    dimension: int = 768
    normalise: bool = True
    batch_size: int = 32
