"""All named queries with their SQL."""

from . import answering, cases, retrieval, scoring, sources, structuring

_MODULES = (retrieval, structuring, scoring, cases, answering, sources)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
