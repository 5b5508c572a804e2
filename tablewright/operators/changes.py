"""State of a keyed change log as of a version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.names import quoted
from tablewright.operators.mutate import Expression, as_column, holds


def as_of(
    changes: DataFrame,
    keys: Sequence[str],
    version: Sequence[str],
    at: Expression = "true",
    tombstone: Expression = "false",
) -> DataFrame:
    """The latest change per key among those where ``at`` holds, without deleted keys.

    ``version`` are the columns that order the changes of a key. The latest row is an aggregate,
    not a sorted window: each task reduces its own rows to one per key before the shuffle, so a
    key with most of the changes sends one row per task.
    """

    def packed(columns: Sequence[str]) -> Column:
        return F.struct(*map(quoted, columns))

    latest = (
        changes.where(as_column(at))
        .groupBy(*map(quoted, keys))
        .agg(F.max_by(packed(changes.columns), packed(version)).alias("__row"))
        .select("__row.*")
    )
    return latest.where(~holds(tombstone))
