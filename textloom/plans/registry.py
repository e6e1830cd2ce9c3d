"""The registered queries and the SQL they are checked against."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.scale import spread
from textloom.session import ship

# Tables with heavy work per row: a small single file must not keep all but one core idle.
TEXT_TABLES = ("documents", "pages")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as attributes, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table


def plan(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with the equivalent SQL where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return add
