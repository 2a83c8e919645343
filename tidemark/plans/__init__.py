"""The query catalogue: name → (callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

_MODULES = ["problems", "asof", "relational", "scalars", "statistics", "views", "streams", "sources", "models", "more"]


def catalogue() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= importlib.import_module(f"tidemark.plans.{m}").QUERIES
    return out
