"""All registered queries of the library and their SQL."""

from __future__ import annotations

from curbsense.plans import guidance, more, spatial, tables, travel

MODULES = [spatial, tables, travel, more, guidance]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
