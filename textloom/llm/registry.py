"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Register ``fn`` over one or more whole tables, named with spaces between, with its SQL where there is one."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(*[spark.read.parquet(f"{folder}/{table}.parquet") for table in tables.split()])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return add
