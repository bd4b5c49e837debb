"""All named queries of the core and their SQL twins."""

from __future__ import annotations

from flipgraph.operators import references
from flipgraph.plans import aggregates, attribution, context, evaluation, graph, pipelines, projections, ranking, robustness, search, sources, streaming, structure

_CATALOGS = (aggregates.C, ranking.C, graph.C, search.C, attribution.C, structure.C, projections.C, context.C, sources.C, evaluation.C, pipelines.C, robustness.C, streaming.C)


def queries() -> dict:
    named = {"p3_found": references.p3_found, "p3_counts": references.p3_counts}
    for c in _CATALOGS:
        named |= c.queries
    return named


def oracle_sql() -> dict:
    sql = dict(references.P3_SQL)
    for c in _CATALOGS:
        sql |= c.sql
    return sql
