"""Sessions: the settings the jobs expect, user settings on top, and isolation per script."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

DEFAULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesces small shuffle partitions, splits skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def parse_settings(arguments: Iterable[str]) -> dict[str, str]:
    """Turn ``key=value`` arguments into settings; text without ``=`` is skipped."""
    pairs = (argument.split("=", 1) for argument in arguments)
    return {pair[0]: pair[1] for pair in pairs if len(pair) == 2}


def build_session(
    app_name: str = "tabular-sql-jobs",
    settings: Mapping[str, str] | None = None,
    master: str | None = None,
    schema: str | None = None,
) -> SparkSession:
    """Start (or join) a session; ``settings`` win over the defaults, ``schema`` is then in use.

    ``spark.sql.defaultCatalog`` and ``spark.sql.catalog.<name>…`` entries are ordinary settings
    here, so a three-level name or a short name resolves as the cluster's catalog says.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULT_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if schema is not None:
        spark.catalog.setCurrentDatabase(schema)
    return spark


def isolated_session(
    spark: SparkSession, settings: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the same tables and SQL settings but its own views, functions and ``USE``."""
    child = spark.newSession()
    for key, _ in spark.sql("SET").collect():
        # Catalogs are settings that Spark does not know by name, so it does not call them modifiable.
        catalog = key == "spark.sql.defaultCatalog" or key.startswith("spark.sql.catalog.")
        if catalog or (key.startswith("spark.sql.") and spark.conf.isModifiable(key)):
            # The list of settings hides secrets; the setting itself does not.
            child.conf.set(key, spark.conf.get(key))
    for key, value in (settings or {}).items():
        child.conf.set(key, value)
    child.catalog.setCurrentCatalog(spark.catalog.currentCatalog())
    child.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    return child
