"""All queries and their SQL."""

from __future__ import annotations

from workload import ingest_queries, maintenance_queries, metric_queries, store_queries, text_queries

_GROUPS = (metric_queries, text_queries, maintenance_queries, ingest_queries, store_queries)

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
