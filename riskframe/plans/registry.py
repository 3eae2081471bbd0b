"""Registry of named queries and their SQL oracles.

``@query(name, sql)`` registers a builder ``(spark, sf_dir) -> DataFrame``; ``sql`` is the DuckDB statement
over the driver's tables that must return the same rows (``None`` = no SQL form; rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
