"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Queries and SQL by name, and a decorator that enters a query, with its SQL if it has any, under its own name."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def enter(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return enter

    return queries, oracle, query
