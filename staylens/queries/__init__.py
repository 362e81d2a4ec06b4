"""Registered queries on the test tables, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a function as a query under its own name, with its SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


from staylens.queries import listings, offers, pages, platforms, scalars  # noqa: E402, F401
