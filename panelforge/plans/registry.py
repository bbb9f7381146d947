"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column half away from zero, so that summation order does not show.

    Plain double arithmetic instead of ``round``, which goes through decimals row by row. -0.0 becomes 0.0.
    """
    unit = F.lit(10.0 ** digits)

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.DoubleType):
            return c
        return (F.signum(c) * F.floor(F.abs(c) * unit + 0.5) / unit + F.lit(0.0)).alias(f.name)

    return df.select(*[one(f) for f in df.schema])


def r(expr: str, alias: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded` for one column."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {alias}"
