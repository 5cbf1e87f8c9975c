"""All queries of the engine, and their SQL."""

from quire.plans import boundary_queries, layout_queries, more_queries, plan_queries, queries, store_queries, text_queries, validity_queries

MODULES = (queries, more_queries, layout_queries, boundary_queries, text_queries, store_queries, plan_queries, validity_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
