"""All registered queries and their SQL."""

from __future__ import annotations

from ragstone.plans import catalog, catalog_more  # noqa: F401  the second adds to the first

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL
