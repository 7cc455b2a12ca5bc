"""The engine's queries and their equivalent SQL."""

from __future__ import annotations

from fathom.plans import ingest, parsing, retrieval, serving, texts  # noqa: F401  registers their queries
from fathom.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "retrieve_topk"


def queries() -> dict[str, Query]:
    """All queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(SQL)
