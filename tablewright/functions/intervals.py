"""What lies in the time before each row, per key, when keys repeat on both sides.

A join on the key alone meets every row of a key with every other one. Here time buckets as wide as
the interval are part of the key. A row that is looked for stands in its own bucket and in the next,
a row that asks stands in its own, so all that it can reach is there; a frame over the rows of one key
and bucket then gives aggregates without making pairs. Work grows with the rows and a task holds what
one key has in two intervals, however much the key has in all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.names import quoted

BUCKET, ASKS, REACHED = "__bucket", "__asks", "r"


def _start(df: DataFrame, time: str, width: str) -> Column:
    """The bucket of a row, NULL without a time (a window alone would drop such rows)."""
    at = F.col(quoted(time))
    some = F.coalesce(at, F.lit("1970-01-01").cast(df.schema[time].dataType))
    return F.when(at.isNotNull(), F.window(some, width)["start"])


def _null_keys(df: DataFrame, columns: Sequence[str]) -> Column:
    none = F.lit(False)
    for column in columns:
        none |= F.col(quoted(column)).isNull()
    return none


def within_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    width: str,
    aggregates: Mapping[str, str],
    upto_peers: bool = False,
) -> DataFrame:
    """The rows of ``left`` with aggregates over the rows of ``right`` that have its keys and lie in
    the ``width`` (an interval such as ``1 hour``) before its ``time``.

    ``aggregates`` are SQL over the row ``r`` of ``right``, such as ``count(r)`` or ``max(r.value)``.
    As a join (the usual), the instant itself does not count, nor do rows with a NULL in a key or in
    the time: a row of ``left`` without them reaches nothing. With ``upto_peers`` it is the frame
    ``RANGE BETWEEN width PRECEDING AND CURRENT ROW``, in which NULLs are peers.
    """
    for name in (BUCKET, ASKS, REACHED):
        if name in left.columns:
            raise ValueError(f"the column name {name} is reserved")
    places = [*keys, time]
    row = F.struct(*(F.col(quoted(c)) for c in right.columns)).alias(REACHED)
    if upto_peers:
        asking, reached, end = left, right, "CURRENT ROW"
    else:
        # The least step of a timestamp leaves out the instant itself.
        end = "INTERVAL '0 00:00:00.000001' DAY TO SECOND PRECEDING"
        asking, reached = left.where(~_null_keys(left, places)), right.where(~_null_keys(right, places))
    both = F.array_distinct(F.array(BUCKET, F.col(BUCKET) + F.expr(f"INTERVAL {width}")))
    copies = (
        reached.select(*map(quoted, places), row)
        .withColumn(BUCKET, _start(reached, time, width))
        .withColumn(BUCKET, F.explode(both))
        .withColumn(ASKS, F.lit(False))
    )
    questions = asking.withColumn(BUCKET, _start(asking, time, width)).withColumn(ASKS, F.lit(True))
    part = ", ".join(map(quoted, [*keys, BUCKET]))
    frame = (
        f"OVER (PARTITION BY {part} ORDER BY {quoted(time)} "
        f"RANGE BETWEEN CAST(INTERVAL {width} AS INTERVAL DAY TO SECOND) PRECEDING AND {end})"
    )
    answers = {name: F.expr(f"{aggregate} {frame}") for name, aggregate in aggregates.items()}
    answered = (
        questions.unionByName(copies, allowMissingColumns=True)
        .select("*", *(a.alias(name) for name, a in answers.items()))
        .where(ASKS)
        .select(*map(quoted, left.columns), *aggregates)
    )
    if upto_peers:
        return answered
    # What the aggregates give over no rows.
    none = right.limit(0).select(row)
    nothing = [none.select(F.expr(a).alias(n)).scalar().alias(n) for n, a in aggregates.items()]
    return answered.unionByName(left.where(_null_keys(left, places)).select("*", *nothing))
