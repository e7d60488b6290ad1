"""The registered queries over the graph and run-metric operators, sources and sinks, and their SQL."""

from __future__ import annotations

from . import graph_queries, metric_queries, source_queries

QUERIES = graph_queries.QUERIES | metric_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = graph_queries.ORACLE_SQL | metric_queries.ORACLE_SQL | source_queries.ORACLE_SQL
