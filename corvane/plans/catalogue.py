"""The named queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from . import queries_aggregates, queries_data, queries_expressions, queries_joins, queries_sets, queries_sql, queries_subqueries
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries", "queries_aggregates", "queries_data", "queries_expressions", "queries_joins", "queries_sets", "queries_sql", "queries_subqueries"]
