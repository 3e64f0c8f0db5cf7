"""All queries of the engine's own operators."""

from __future__ import annotations

from . import code_queries, core_queries, data_queries, graph_queries, index_queries, record_queries, store_queries, temporal_queries, text_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
