"""Registered queries and their SQL statements for the check engine."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def flat(df: DataFrame) -> DataFrame:
    """Column names that need no quoting in the check engine."""
    return df.withColumnsRenamed({"user": "author", "start": "start_at", "end": "end_at", "first": "first_tok", "last": "last_tok"})


def r6(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6) + F.lit(0.0)


def long(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("long")
