"""Registry of named queries and their independent SQL oracles.

Each query is a function ``(spark, sf_dir) -> DataFrame``.  An oracle is a
DuckDB-dialect SQL string over the driver tables, written independently of the
Spark code, that must return the same rows (column names aliased alike).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def sql_list(values) -> str:
    """DuckDB list literal of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
