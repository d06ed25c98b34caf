"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvella.sources.views import Tables, with_views


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Registers a function of Tables under its name. sql may use the domain views."""

        def add(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[key] = with_views(sql)
            return f

        return add
