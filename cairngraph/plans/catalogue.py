"""Named graph queries over the driver tables, each with an independent SQL oracle."""

from __future__ import annotations

from cairngraph.plans import graph_queries, lookup_queries, text_queries, upkeep_queries
from cairngraph.plans.registry import ORACLES, QUERIES, Query

__all__ = ["graph_queries", "lookup_queries", "oracle_sql", "queries", "text_queries", "upkeep_queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
