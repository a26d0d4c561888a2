"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import metric_queries, quant_queries, search_queries

PARTS = (search_queries, metric_queries, quant_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
