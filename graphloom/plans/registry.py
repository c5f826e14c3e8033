"""All registered queries of the engine, and their SQL."""

from . import corpus, cypher_queries, graph_queries, project_queries

MODULES = [graph_queries, cypher_queries, corpus, project_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
