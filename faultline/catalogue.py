"""Registered queries and their SQL oracles."""

from __future__ import annotations

from faultline.plans import capture_queries, ledger_queries

QUERIES: dict = capture_queries.QUERIES | ledger_queries.QUERIES
ORACLE_SQL: dict = capture_queries.ORACLE_SQL | ledger_queries.ORACLE_SQL
