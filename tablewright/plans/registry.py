"""Queries by name, each with the SQL that says the same, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the table ``orders`` of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)


def query(name: str, oracle: str | None = None):
    """Register a function of :class:`Tables` under ``name``."""

    def register(function: Callable[[Tables], DataFrame]) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, directory: str) -> DataFrame:
            return function(Tables(spark, directory))

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register
