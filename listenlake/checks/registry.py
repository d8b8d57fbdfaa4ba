"""Named queries and the DuckDB statements they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listenlake.checks.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query with its statement.

    `sql` is a select over the fixture views, or starts with `, view as (…)`
    to add views of its own.
    """

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = with_views(sql, recursive)
        return query

    return register
