"""All registered queries of the library and the SQL they are compared with."""

from __future__ import annotations

from limpid.plans import cleaning_queries, dependency_queries, profile_queries, scoring_queries, stream_queries

_MODULES = (dependency_queries, profile_queries, scoring_queries, cleaning_queries, stream_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
