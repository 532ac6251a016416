"""Every query of the event-log engine, by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from sessionloom.plans import cluster_queries, envelope_queries, log_queries, metric_queries, source_queries

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (log_queries, envelope_queries, metric_queries, cluster_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
