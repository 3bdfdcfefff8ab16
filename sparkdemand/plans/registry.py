"""Registry of named queries: a Spark callable and, where SQL can express it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the inventory id it implements."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round all floating columns for comparison.

    Means of two-digit prices often end in an exact tie, which the order of summation would decide; a nudge
    far below the last digit makes them round away from zero always.
    """
    kinds = (T.DoubleType, T.FloatType)
    nudge = 3 * 10.0 ** -(digits + 4)
    return df.withColumns(
        {f.name: F.round(F.col(f.name) + F.signum(f.name) * nudge, digits) for f in df.schema.fields if isinstance(f.dataType, kinds)}
    )
