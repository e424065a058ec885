"""Named queries over the test tables, each with its DuckDB counterpart."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that must give the same rows."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLES[name] = sql.strip()
        return fn

    return keep
