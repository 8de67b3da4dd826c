"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle is not None:
            SQL[f.__name__] = sql(oracle)
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + 0.0
