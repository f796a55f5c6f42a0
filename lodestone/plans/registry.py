"""The library's own queries and their SQL, by the names that __spark_entry__.py lists."""

from __future__ import annotations

from lodestone.plans import index_queries, json_queries, lookup, release_queries, scalar_queries, search_queries

QUERIES: dict = {**scalar_queries.QUERIES, **search_queries.QUERIES, **index_queries.QUERIES, **json_queries.QUERIES, **release_queries.QUERIES, **lookup.QUERIES}
ORACLE_SQL: dict = {**scalar_queries.ORACLE_SQL, **search_queries.ORACLE_SQL, **index_queries.ORACLE_SQL, **json_queries.ORACLE_SQL, **release_queries.ORACLE_SQL, **lookup.ORACLE_SQL}
FLAGSHIP = "lookup_e2e"
