"""INSERT, UPDATE and DELETE as DataFrame transformations (the input is never changed)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tablewright.functions.names import quoted

Expression = Column | str

AFFECTED = "__affected"  # where an update keeps what it selects, while it runs


def as_column(expression: Expression) -> Column:
    """SQL text or a ready column."""
    return F.expr(expression) if isinstance(expression, str) else expression


def holds(predicate: Expression) -> Column:
    """Whether ``predicate`` is true; NULL counts as not true."""
    return F.coalesce(as_column(predicate), F.lit(False))


def append_rows(df: DataFrame, rows: DataFrame, by_position: bool = False) -> DataFrame:
    """``df`` followed by ``rows``, matched by name and stored in ``df``'s types.

    A column that ``rows`` lacks is NULL. An unknown column or a type that cannot be stored
    (text into a number) is refused at analysis, an overflow at run time. By position, as
    ``INSERT INTO t VALUES`` does, ``rows`` has as many columns as ``df``, whatever their names.
    """
    return df.unionByName(conform(rows, df.schema, by_position))


def unknown_names(names: Iterable[str], schema: StructType) -> list[str]:
    """Those of ``names`` that ``schema`` lacks, without regard to case, as Spark resolves names."""
    known = {name.lower() for name in schema.names}
    return [name for name in names if name.lower() not in known]


def conform(rows: DataFrame, schema: StructType, by_position: bool = False) -> DataFrame:
    """``rows`` in the columns and types of ``schema``, by the rules of an insert."""
    if by_position:
        if len(rows.columns) != len(schema):
            raise ValueError(f"{len(rows.columns)} columns for the {len(schema)} of the target")
        rows = rows.toDF(*schema.names)
    unknown = unknown_names(rows.columns, schema)
    if unknown:
        raise ValueError(f"columns not in the target: {', '.join(unknown)}")
    nullable = StructType([StructField(field.name, field.dataType) for field in schema.fields])
    return rows.to(nullable).withColumns(
        {
            field.name: required(F.col(quoted(field.name)), field.name)
            for field in schema.fields
            if not field.nullable
        }
    )


def required(value: Column, name: str) -> Column:
    """``value``, or an error at run time where it is NULL."""
    return F.coalesce(value, F.raise_error(F.lit(f"NULL in column {name}, which is NOT NULL")))


def update_rows(
    df: DataFrame, assignments: Mapping[str, Expression], where: Expression = "true"
) -> DataFrame:
    """``UPDATE df SET c = e, … WHERE p``: same rows, rows where ``p`` is true changed.

    Every right-hand side sees the old row, is evaluated only for selected rows, and is stored in
    the declared type of its column.
    """
    unknown = unknown_names(assignments, df.schema)
    if unknown:
        raise ValueError(f"columns not in the table: {', '.join(unknown)}")
    if AFFECTED in df.columns:
        raise ValueError(f"the column name {AFFECTED} is reserved")
    declared_name = {name.lower(): name for name in df.columns}
    assignments = {declared_name[name.lower()]: e for name, e in assignments.items()}
    new = {name: f"__new_{i}" for i, name in enumerate(assignments)}
    affected = holds(where)
    declared = StructType(
        df.schema.fields
        + [StructField(AFFECTED, BooleanType(), True)]
        + [StructField(new[name], df.schema[name].dataType, True) for name in assignments]
    )
    evaluated = df.select(
        "*",
        affected.alias(AFFECTED),
        *(F.when(affected, as_column(e)).alias(new[name]) for name, e in assignments.items()),
    ).to(declared)
    chosen = {
        name: F.when(
            F.col(AFFECTED),
            F.col(new[name]) if df.schema[name].nullable else required(F.col(new[name]), name),
        ).otherwise(F.col(quoted(name)))
        for name in assignments
    }
    return evaluated.withColumns(chosen).select(*map(quoted, df.columns))


def delete_rows(df: DataFrame, where: Expression = "true") -> DataFrame:
    """``DELETE FROM df WHERE p``: rows where ``p`` is false or NULL stay."""
    return df.where(~holds(where))
