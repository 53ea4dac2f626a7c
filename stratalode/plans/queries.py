"""All queries of the store's own operators, and their SQL."""

from stratalode.plans import graph_queries, object_queries, record_queries, store_queries, vector_queries

MODULES = (record_queries, vector_queries, graph_queries, object_queries, store_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
