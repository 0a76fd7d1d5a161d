"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundloom.session import load


class Tables:
    """Tables of one data directory by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


class Registry:
    """Queries of a module and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.SQL[name] = sql
            return f

        return register
