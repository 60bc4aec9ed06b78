"""Queries by name, and the SQL that gives the same rows."""

from . import catalog_queries, data_queries, record_queries

MODULES = (catalog_queries, data_queries, record_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
