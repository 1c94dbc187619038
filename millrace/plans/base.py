"""The query registry: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, t) -> DataFrame, where t(name) reads a table of the folder, and its DuckDB SQL."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(spark, lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return function

    return register
