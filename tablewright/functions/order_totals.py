"""Totals over all rows of another table with a smaller value: an inequality join without pairs.

Both sides are reduced to their different values, which are put in order once, by a range
partitioning. Each slice of values is summed, the sums of the slices before are carried over to each
slice, and a running sum inside a slice does the rest. No row meets another one; equal values, however
many rows have them, are one row before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.names import quoted
from tablewright.functions.skew import SLICE
from tablewright.sources.folders import fresh_folder

VALUE = "__value"


def _sum(local: Column, before: Column) -> Column:
    """The sum of two sums of which either may be of no rows."""
    return F.coalesce(local + before, local, before)


def totals_below(
    df: DataFrame, value: str, other: DataFrame, other_value: str, sums: Mapping[str, Column]
) -> DataFrame:
    """``df`` with ``sums`` over the rows of ``other`` whose ``other_value`` is less than ``value``.

    A sum over no rows is NULL, as in SQL; so it is where ``value`` is NULL. NULL in ``other_value``
    is less than nothing. The values are written to the shared folder when the query is built.
    """
    asked = df.select(F.col(quoted(value)).alias(VALUE)).where(F.col(VALUE).isNotNull()).distinct()
    given = (
        other.where(F.col(quoted(other_value)).isNotNull())
        .groupBy(F.col(quoted(other_value)).alias(VALUE))
        .agg(*(F.sum(column).alias(name) for name, column in sums.items()))
    )
    points = (
        given.unionByName(asked, allowMissingColumns=True)
        .groupBy(VALUE)
        .agg(*(F.sum(name).alias(name) for name in sums))
    )
    path = fresh_folder(df.sparkSession, "values")
    points.repartitionByRange(VALUE).withColumn(SLICE, F.spark_partition_id()).write.parquet(path)
    sliced = df.sparkSession.read.parquet(path)

    # One row per slice, so at most as many as there are shuffle partitions.
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(SLICE)
        .agg(*(F.sum(name).alias(name) for name in sums))
        .select(SLICE, *(F.sum(name).over(earlier).alias(f"__before_{name}") for name in sums))
    )
    lower = Window.partitionBy(SLICE).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select(VALUE, SLICE, *(F.sum(name).over(lower).alias(name) for name in sums))
    totals = local.join(F.broadcast(carried), SLICE).select(
        VALUE, *(_sum(F.col(name), F.col(f"__before_{name}")).alias(name) for name in sums)
    )
    joined = df.join(totals, F.col(quoted(value)) == F.col(VALUE), "left")
    return joined.drop(VALUE)
