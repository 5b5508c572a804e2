"""The Parquet tables the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def location(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(location(directory, name))


def register(spark: SparkSession, directory: str, *names: str) -> SparkSession:
    """Register tables as temporary views of ``spark`` (all of them when none is named)."""
    for name in names or TABLES:
        table(spark, directory, name).createOrReplaceTempView(name)
    return spark
