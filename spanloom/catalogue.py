"""Registered queries of the reference's operators, by name, with the SQL they are held against."""

from __future__ import annotations

from spanloom.plans import decoding_queries, interval_queries, operator_queries, relational_queries, review_queries, sequence_queries, streaming_queries, text_queries

_MODULES = (interval_queries, sequence_queries, text_queries, relational_queries, review_queries, decoding_queries, operator_queries, streaming_queries)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
