"""All queries of the library with their SQL."""

from __future__ import annotations

from conceptspark.plans import analytics, captured, encoding, structure

QUERIES = encoding.QUERIES | analytics.QUERIES | captured.QUERIES | structure.QUERIES
ORACLE_SQL = encoding.ORACLE_SQL | analytics.ORACLE_SQL | captured.ORACLE_SQL | structure.ORACLE_SQL
