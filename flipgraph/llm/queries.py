"""All named queries of this subpackage and their SQL twins."""

from __future__ import annotations

from flipgraph.llm import frequency, lookalikes, mixing, packing, pairs, residue, topn

_MODULES = (lookalikes, pairs, frequency, topn, packing, mixing, residue)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
