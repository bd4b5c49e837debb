"""A catalogue of named queries: each module of plans registers its own in one."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    """Named queries with, where SQL can say the same, their DuckDB twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        def keep(query: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return keep
