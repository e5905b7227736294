"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import graph_queries, source_queries, text_queries

MODULES = (graph_queries, text_queries, source_queries)
entry = graph_queries.flagship


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
