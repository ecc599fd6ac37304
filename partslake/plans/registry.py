"""Registered queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to work on, over all cores.

    A file is split by row groups, so a table in one group would keep one core busy. A local
    session asks for the spread by a setting (see ``partslake.session``); without it, as on a
    cluster that reads many files, nothing moves.
    """
    df = table(spark, sf_dir, name)
    parts = spark.conf.get("spark.partslake.spread", None)
    return df.repartition(int(parts), key) if parts else df
