"""Registration of queries that are the same text for Spark and for the SQL check, or a DataFrame with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.session import TABLES, register

_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def text(self, name: str, spark_sql: str, sql: str | None = None) -> None:
        """A query given as SQL; `sql` is its twin where the dialects differ."""
        tables = sorted(set(_NAMES.findall(spark_sql)))

        def run(spark: SparkSession, d: str) -> DataFrame:
            register(spark, d, tables)
            return spark.sql(spark_sql)

        self.add(name, run, sql or spark_sql)
