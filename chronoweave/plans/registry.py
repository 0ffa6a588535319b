"""Where plan modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a plan (spark, sf_dir) -> DataFrame, with its SQL where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add
