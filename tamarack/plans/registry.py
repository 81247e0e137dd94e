"""Named queries over the driver's tables and the SQL that must agree with them."""

from __future__ import annotations

from tamarack.plans import profile_queries, table_queries

QUERIES: dict = table_queries.QUERIES | profile_queries.QUERIES
ORACLE_SQL: dict = table_queries.ORACLE_SQL | profile_queries.ORACLE_SQL
