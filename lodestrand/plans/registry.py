"""Queries: a function over DataFrames, and, told apart from it, SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None  #: None where SQL can't tell it; then tests do


class Registry(dict[str, Query]):
    def add(self, sql: str | None, name: str | None = None):
        """A decorator that registers a function by its name."""
        def put(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            key = name or fn.__name__
            if key in self:
                raise ValueError(f"{key} is registered twice")
            self[key] = Query(fn, sql)
            return fn

        return put
