"""A registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers a function of a table reader, t(name) -> DataFrame."""

        def register(f):
            self.queries[name] = lambda spark, d: f(lambda n: table(spark, d, n))
            if sql:
                self.sql[name] = sql
            return f

        return register
