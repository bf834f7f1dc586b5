"""Every query of the package, by operator id, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLE[name] = oracle
        return query

    return add


def queries() -> dict[str, Query]:
    from .plans import catalog  # noqa: F401  registers every query

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .plans import catalog  # noqa: F401

    return dict(_ORACLE)
