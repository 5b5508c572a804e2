"""Schema and row counts of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``column, type, nullable, n_rows, n_null``.

    A single aggregate counts everything, so the only shuffle moves one row per task.
    """
    fields = df.schema.fields
    values = df.toDF(*(f"c{i}" for i in range(len(fields))))
    counts = values.agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.count(c).alias(c) for c in values.columns)
    )
    described = F.array(
        *(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.lit(field.nullable).alias("nullable"),
                F.col("n_rows"),
                (F.col("n_rows") - F.col(column)).alias("n_null"),
            )
            for field, column in zip(fields, values.columns)
        )
    )
    return counts.select(F.inline(described))


def schema_summary(df: DataFrame) -> str:
    """The schema tree and the number of rows, as text (labels are fixed values)."""
    n_rows = df.agg(F.count(F.lit(1))).first()[0]
    return f"Schema:\n{df.schema.treeString()}\nRow count: {n_rows}"
