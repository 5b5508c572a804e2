"""Exact numbers of different values at every level of a rollup, and sketches that are kept.

A rollup by ``Expand`` copies each row once a level and the values are made distinct again at each.
Here different values get dense numbers; a group is a set of bitmaps over those numbers, made once at
the finest level and merged from each level to the next. A bitmap stands for 32,768 numbers in 4 KB,
however many rows have them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.names import quoted
from tablewright.functions.skew import SLICE
from tablewright.sources.folders import fresh_folder


def dense_numbers(df: DataFrame, column: str) -> DataFrame:
    """``value, number`` for the different values of a column, numbered without gaps from 0.

    Values are put in order by a range partitioning that is written down; a number is that of the
    values in the slices before, of which there are few, plus the place in the slice.
    """
    values = df.select(F.col(quoted(column)).alias("value")).where("value IS NOT NULL").distinct()
    path = fresh_folder(df.sparkSession, "numbers")
    values.repartitionByRange("value").withColumn(SLICE, F.spark_partition_id()).write.parquet(path)
    sliced = df.sparkSession.read.parquet(path)
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(SLICE).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(SLICE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(SLICE).orderBy("value"))
    return (
        sliced.withColumn("__place", place)
        .join(F.broadcast(before), SLICE)
        .select("value", (F.col("__before") + F.col("__place") - 1).alias("number"))
    )


def rollup_distinct(
    df: DataFrame,
    levels: Sequence[str],
    column: str,
    name: str,
    number: Column | None = None,
) -> DataFrame:
    """``levels``, ``level`` and, under ``name``, how many different values of ``column`` each group of
    ``ROLLUP (levels)`` has; ``level`` is how many of the levels are rolled up, which tells a total
    from a NULL in the data.

    ``number`` is a dense whole number of the value, where there is one already (a key that counts
    from 1); else values are numbered first and joined. NULL values do not count.
    """
    groups = [F.col(quoted(level)).alias(level) for level in levels]
    if number is None:
        numbers = dense_numbers(df, column)
        rows = df.select(*groups, F.col(quoted(column)).alias("__v")).join(
            numbers, F.col("__v") == F.col("value"), "left"
        )
        number = F.col("number")
    else:
        rows, number = df.select(*groups, number.cast("bigint").alias("number")), F.col("number")
    finest = rows.groupBy(
        *map(quoted, levels), F.bitmap_bucket_number(number).alias("__bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("__map"))
    out = None
    for n in range(len(levels), -1, -1):
        kept = [quoted(level) for level in levels[:n]]
        maps = finest.groupBy(*kept, "__bucket").agg(F.bitmap_or_agg("__map").alias("__map"))
        size = F.when(F.col("__bucket").isNull(), 0).otherwise(F.bitmap_count("__map"))
        counted = maps.groupBy(*kept).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias(name))
        rolled = [F.lit(None).cast(df.schema[level].dataType).alias(level) for level in levels[n:]]
        part = counted.select(*kept, *rolled, F.lit(len(levels) - n).alias("level"), name)
        out = part if out is None else out.unionAll(part)
        finest = maps
    return out


def kept_sketches(df: DataFrame, groups: Sequence[Column], column: str) -> DataFrame:
    """A row per group with a HyperLogLog sketch of a column, ``sketch``, written to the shared
    folder: later groups are merged from these rows, without reading the data again."""
    path = fresh_folder(df.sparkSession, "sketches")
    df.groupBy(*groups).agg(F.hll_sketch_agg(F.col(quoted(column))).alias("sketch")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def merged_estimates(sketches: DataFrame, groups: Sequence[Column], name: str) -> DataFrame:
    """The estimated number of different values of each group of kept sketches."""
    return sketches.groupBy(*groups).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name)
    )
