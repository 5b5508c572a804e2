"""Exact percentiles by selection, for columns with any number of different values.

The percentile aggregate keeps every different value of a group in one buffer. Here the rows of a
group are counted in bins between bounds, the bin that holds the wanted rank gives the next bounds,
its own least and greatest value, and so on until the rows between the bounds are what one task
sorts. A round is one scan with a row per bin as its result. Groups of fewer rows than that are sorted
at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.functions import skew
from tablewright.functions.names import quoted
from tablewright.sources.folders import fresh_folder

BINS = 1024


def _staged(df: DataFrame) -> DataFrame:
    path = fresh_folder(df.sparkSession, "percentiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(keys: Sequence[str]):
    same = F.lit(True)
    for key in keys:
        same &= F.col(quoted(key)).eqNullSafe(F.col(f"__of_{key}"))
    return same


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]
) -> DataFrame:
    """``keys, fraction, percentile`` for every group and fraction, interpolated between the two
    values next to the rank ``fraction * (n - 1)``, as ``percentile`` does.

    NULL values do not count, nor does a group of them alone. A group with more rows than
    ``skew.TASK_ROWS`` is narrowed down by rounds; the bound changes the plan and not the result.
    """
    rows = df.select(
        *map(quoted, keys), F.col(quoted(value)).cast("double").alias("__v")
    ).where("__v IS NOT NULL")
    wanted = F.explode(F.array(*(F.lit(float(f)) for f in fractions))).alias("fraction")
    ranks = (
        rows.groupBy(*map(quoted, keys))
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        .select("*", wanted)
        .withColumn("__h", F.col("fraction") * (F.col("__n") - 1))
        .select(
            *map(quoted, keys),
            "fraction",
            "__h",
            # Both neighbours of the rank; they are the same where it is whole.
            F.explode(F.array_distinct(F.array(F.floor("__h"), F.ceil("__h")))).alias("__rank"),
            "__low",
            "__high",
            F.lit(0).cast("bigint").alias("__below"),
            F.col("__n").alias("__inside"),
        )
    )
    state = _staged(ranks)
    open_ = (F.col("__inside") > skew.TASK_ROWS) & (F.col("__low") < F.col("__high"))
    while state.where(open_).limit(1).count():
        state = _staged(state.where(~open_).unionByName(_narrowed(rows, keys, state.where(open_))))
    return _selected(rows, keys, state)


def _near(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """The rows between the bounds of each rank that is wanted of their group."""
    bounds = state.withColumnsRenamed({key: f"__of_{key}" for key in keys})
    return rows.join(bounds, _same(keys) & F.col("__v").between(F.col("__low"), F.col("__high")))


def _narrowed(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """Bounds that hold one bin of those before. Only groups of many rows come here, so ``state`` has
    few; which of the equally wide bins a value is in never falls as the value grows."""
    low, high = F.col("__low"), F.col("__high")
    width = high / BINS - low / BINS  # does not overflow
    share = F.try_divide(F.col("__v") / BINS - low / BINS, width)
    inner = F.least(F.greatest(F.coalesce(F.floor(share * BINS), F.lit(0)), F.lit(0)), F.lit(BINS - 1))
    # The least and the greatest value have bins of their own, so every round parts them.
    binned = F.when(F.col("__v") == low, -1).when(F.col("__v") == high, BINS).otherwise(inner)
    group = [*map(quoted, keys), "fraction", "__h", "__rank", "__below"]
    bins = (
        _near(rows, keys, state)
        .withColumn("__bin", binned)
        .groupBy(*group, "__bin")
        .agg(
            F.count(F.lit(1)).alias("__inside"),
            F.min("__v").alias("__low"),
            F.max("__v").alias("__high"),
        )
    )
    before = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = bins.withColumn(
        "__under", F.col("__below") + F.coalesce(F.sum("__inside").over(before), F.lit(0))
    )
    held = (F.col("__rank") >= F.col("__under")) & (
        F.col("__rank") < F.col("__under") + F.col("__inside")
    )
    return counted.where(held).select(
        *map(quoted, keys),
        "fraction",
        "__h",
        "__rank",
        "__low",
        "__high",
        F.col("__under").alias("__below"),
        "__inside",
    )


def _selected(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """The values at the ranks: between bounds there are as many rows as a task sorts, or one value."""
    group = [*map(quoted, keys), "fraction", "__h", "__rank", "__below"]
    values = _near(rows, keys, state).groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted = values.withColumn("__upto", F.col("__below") + F.sum("__n").over(upto))
    held = (F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n"))
    low, high = F.min_by("__v", "__rank"), F.max_by("__v", "__rank")
    part = F.first("__h") - F.floor(F.first("__h"))
    return (
        counted.where(held)
        .groupBy(*map(quoted, keys), "fraction")
        .agg(F.when(low == high, low).otherwise(low + (high - low) * part).alias("percentile"))
    )
