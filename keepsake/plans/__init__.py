"""Registered queries over the given tables, and the SQL that they are held against."""

from keepsake.plans import analytics, catalog, curation, exports, imports, library, views

_MODULES = (catalog, curation, analytics, imports, library, exports, views)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
