"""Governed reads: a row filter and column masks in front of a table.

This is a data transformation, not a security boundary: whoever can read the files can read the
raw values. Give readers the view, and the files only to the job that makes it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tablewright.operators.mutate import Expression, as_column, unknown_names


def governed(
    df: DataFrame,
    row_filter: Expression | None = None,
    masks: Mapping[str, Expression] | None = None,
) -> DataFrame:
    """Rows where ``row_filter`` is true on the raw values, masked columns replaced.

    The filter comes first and stays a plain predicate, so it reaches the scan; all masks are one
    projection over the raw row. What is selected or filtered later sees masked values only.
    """
    masks = masks or {}
    unknown = unknown_names(masks, df.schema)
    if unknown:
        raise ValueError(f"masked columns not in the table: {', '.join(unknown)}")
    visible = df if row_filter is None else df.where(as_column(row_filter))
    declared_name = {name.lower(): name for name in df.columns}
    return visible.withColumns(
        {declared_name[name.lower()]: as_column(mask) for name, mask in masks.items()}
    )


def governed_view(
    df: DataFrame,
    name: str,
    row_filter: Expression | None = None,
    masks: Mapping[str, Expression] | None = None,
) -> None:
    """Register the governed rows as a temporary view, to be read by a plain ``SELECT``."""
    governed(df, row_filter, masks).createOrReplaceTempView(name)
