"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import catalog, documents, functions, state

MODULES = (catalog, functions, documents, state)
QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL
