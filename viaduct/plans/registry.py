"""Queries by name, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries named {f.__name__}")
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from viaduct.plans import aggregates, audits, cameras, captions, choices, clouds, corpus, filters, geometry, grouped, joins, paths, picks, records, relations, series, solving, statistics, texts, tracks  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
