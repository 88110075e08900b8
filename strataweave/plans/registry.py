"""Collecting a module's queries together with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataweave.sources import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of a directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, *names: str) -> DataFrame:
        """A SELECT over the tables that it names in braces, without touching the session's views."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register ``f(tables)`` as a query; ``sql`` gives the same rows."""

        def register(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracle[name] = sql
            return f

        return register
