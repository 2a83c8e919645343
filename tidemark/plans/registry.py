"""A small decorator that collects a module's queries."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict, Callable]:
    """``QUERIES`` and a decorator ``@query(sql)``; the function's name is the query's."""
    found: dict = {}

    def query(sql: str | None = None) -> Callable:
        def put(fn: Callable) -> Callable:
            found[fn.__name__] = (fn, sql)
            return fn

        return put

    return found, query
