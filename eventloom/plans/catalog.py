"""Registered queries and their SQL twins, gathered from the modules beside this one."""

from __future__ import annotations

from eventloom.plans import graph_queries, ingest_queries, insight_queries, maintenance_queries, question_queries, source_queries

MODULES = (graph_queries, ingest_queries, insight_queries, maintenance_queries, question_queries, source_queries)


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, (_, s) in m.QUERIES.items() if s}
