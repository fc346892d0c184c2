"""Registered queries: each builds its views from the given tables and applies one operator or a chain of them."""

from plumery.plans import more_queries, pixel_queries, plume_queries, region_sql, review_queries

MODULES = (plume_queries, review_queries, pixel_queries, more_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in (*MODULES, region_sql) for name, sql in m.ORACLES.items()}
