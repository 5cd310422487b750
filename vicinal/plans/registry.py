"""Registered queries of the scoring engine and their DuckDB equivalents."""

from __future__ import annotations

from vicinal.plans import stream_queries, table_queries, vector_queries

QUERIES: dict = vector_queries.QUERIES | table_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL: dict[str, str] = vector_queries.ORACLE_SQL | table_queries.ORACLE_SQL | stream_queries.ORACLE_SQL
