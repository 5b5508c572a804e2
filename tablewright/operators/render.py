"""Rows for people: bounded previews, JSON lines and delimited text."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the text form.
PREVIEW_ROWS = 1000
SEPARATOR = " | "
NULL_TEXT = "null"
EMPTY_TEXT = "Empty result set"


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """At most ``n`` rows of ``df``; what is left out is not counted."""
    return df.limit(n)


def rows_as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON object per row; fields that are NULL are left out."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def rows_as_text(df: DataFrame, name: str = "value") -> DataFrame:
    """One line per row: the cells as strings, joined by `` | ``, NULL written ``null``."""
    cells = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def cell(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(NULL_TEXT))

    return cells.select(F.concat_ws(SEPARATOR, *map(cell, cells.columns)).alias(name))


def text_header(df: DataFrame) -> list[str]:
    """Column names joined as the rows are, and a dash line as long."""
    names = SEPARATOR.join(df.columns)
    return [names, "-" * len(names)]


def text_report(df: DataFrame, n: int = PREVIEW_ROWS) -> str:
    """Header, at most ``n`` lines and a closing line that says whether rows were left out."""
    lines = [row[0] for row in rows_as_text(df).take(n + 1)]
    if not lines:
        return EMPTY_TEXT
    shown = lines[:n]
    closing = f"Total rows: {len(lines)}" if len(lines) <= n else f"only showing top {n} rows"
    return "\n".join([*text_header(df), *shown, "", closing])


def grid(df: DataFrame, n: int = PREVIEW_ROWS) -> str:
    """Spark's own grid of at most ``n`` rows with whole cells, as a string."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.show(n, truncate=False)
    return out.getvalue()
