"""The queries by name, and SQL that says the same for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(made: Query) -> Query:
        if made.__name__ in QUERIES:
            raise ValueError(f"two queries named {made.__name__}")
        QUERIES[made.__name__] = made
        if sql is not None:
            ORACLES[made.__name__] = sql
        return made

    return register
