"""Name -> query function, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from qaflow.plans import contexts, evaluation, functions, selection, storage, streams  # noqa: F401  they register their queries

    return QUERIES, ORACLE_SQL
