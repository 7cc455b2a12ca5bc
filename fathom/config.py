"""Settings of ingestion and retrieval."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    """Channel sizes, weights, thresholds and fusion options; thresholds and boost are off by default."""

    n_vec: int = 50
    n_bm25: int = 30
    n_graph: int = 20
    max_hops: int = 2
    beam: int = 20
    w_vec: float = 0.40
    w_bm25: float = 0.25
    w_graph: float = 0.20
    w_gear: float = 0.15
    top_k: int = 10
    k1: float = 1.2
    b: float = 0.75
    min_vec: float | None = None
    min_bm25: float | None = None
    min_graph: float | None = None
    boost: float = 0.0


@dataclass(frozen=True)
class IngestConfig:
    """Page windows, vector length and where raw objects live."""

    lines_per_page: int = 20
    vector_dim: int = 64
    raw_prefix: str = "data/raw/"
    keep_markup: bool = False


@dataclass(frozen=True)
class ServingConfig:
    """Quota and embedding limits."""

    daily_limit: int = 1000
    window_seconds: int = 86_400
    default_length: int = 100
    longest: int = 8192
    allowed_domains: tuple[str, ...] = ("example.com",)
