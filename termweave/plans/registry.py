"""Queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a function under its name, with its SQL if it has any."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """df with fractions rounded, so that the order of sums does not show."""
    return df.select(*(F.round(F.col(f"`{c}`").cast("double"), places).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes))


def r(expression: str, places: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE),{places})"


def text(c: str) -> Column:
    return F.col(c).cast("string")
