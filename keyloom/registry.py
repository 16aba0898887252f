"""Names of the engine's queries, each with its Spark form and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that says the same."""

    def put(f: Query) -> Query:
        key = name or f.__name__.rstrip("_")
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from .plans import catalog  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
