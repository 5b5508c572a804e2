"""Recursion over rows: what can be reached from a set of rows, round by round.

Semi-naive: a round joins only the rows that the round before has found new, and what it finds is
compared with what is known by a hash of the key. Each round's new rows are written down, which cuts
the lineage and is what the next round and the result read; nothing but whether there are any comes to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.sources.folders import fresh_folder


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rounds(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths)


def reached(links: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``node, round`` for every node that ``links`` (``source, target``) lead to from ``seeds``
    (``node``, round 0), with the first round that reaches it.

    NULL is no node. Rounds end when one finds nothing new, or after ``most_rounds``.
    """
    spark = links.sparkSession
    root = fresh_folder(spark, "fixpoint")
    links = _staged(
        links.select("source", "target")
        .where("source IS NOT NULL AND target IS NOT NULL AND source != target")
        .distinct(),
        f"{root}/links",
    )
    first = seeds.select("node").where("node IS NOT NULL").distinct()
    new = _staged(first.withColumn("round", F.lit(0)), f"{root}/round=0")
    paths, n = [f"{root}/round=0"], 0
    while new.limit(1).count() and (most_rounds is None or n < most_rounds):
        n += 1
        known = _rounds(spark, paths, new.schema).select("node")
        found = (
            new.join(links, F.col("node") == F.col("source"))
            .select(F.col("target").alias("node"))
            .distinct()
            .join(known, "node", "left_anti")
            .withColumn("round", F.lit(n))
        )
        paths.append(f"{root}/round={n}")
        new = _staged(found, paths[-1])
    return _rounds(spark, paths, new.schema)
