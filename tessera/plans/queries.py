"""All queries over the driver tables: each operator on tables of the same shape as its own, with its SQL."""

from __future__ import annotations

from tessera.plans import code_queries, graph_queries, metric_queries, mining_queries, report_queries, source_queries

FLAGSHIP = "q_threshold_violations"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (metric_queries, graph_queries, mining_queries, code_queries, source_queries, report_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
