"""A registry of named queries: a callable (spark, folder) -> DataFrame and, where SQL can express it, its SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnmill.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
        """Registers a function of a table reader: f(t) with t("staged") the table staged."""

        def register(f: Callable[..., DataFrame]) -> Query:
            @functools.wraps(f)
            def query(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return f(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return register
